"""Prompts and evaluation items as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import without_brackets

LETTERS = [chr(65 + i) for i in range(26)]


def lettered(choices: Column) -> Column:
    """' A. first' and so on, a line each."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit(" "), F.get(F.lit(LETTERS), i), F.lit(". "), c)), "\n")


def multiple_choice(question: Column, choices: Column, listed: str = "letters") -> Column:
    """The prompt with the choices listed by letter, by dash, or not at all."""
    head = F.concat(F.lit("Question: "), question, F.lit("\n"))
    if listed == "letters":
        head = F.concat(head, lettered(choices), F.lit("\n"))
    elif listed == "text":
        head = F.concat(head, F.array_join(F.transform(choices, lambda c: F.concat(F.lit(" - "), c)), "\n"), F.lit("\n"))
    return F.concat(head, F.lit("Answer:"))


def multiple_choice_targets(choices: Column, listed: str = "letters") -> Column:
    """What the model may answer: the letters, or the choices; a blank stands in front."""
    return F.transform(choices, lambda c, i: F.concat(F.lit(" "), F.get(F.lit(LETTERS), i) if listed == "letters" else c))


def gold_from_letter(letter: Column) -> Column:
    """Index of the choice from its letter or its number from 1."""
    by_letter = F.array_position(F.lit(LETTERS), F.upper(F.trim(letter)))
    return F.when(by_letter > 0, by_letter - 1).otherwise(F.trim(letter).try_cast("bigint") - 1)


def chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """Plain chat format for models without a template."""
    parts = [F.concat(F.lit("[SYSTEM]\n"), system), F.concat(F.lit("[USER]\n"), user), F.concat(F.lit("[ASSISTANT]\n"), assistant if assistant is not None else F.lit(""))]
    return F.array_join(F.array(*parts), "\n")


def sentence_start(text: Column) -> Column:
    """The first letter in upper case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000_000))


def with_full_stop(text: Column) -> Column:
    """The text with an end mark, unless it has one."""
    bare = F.rtrim(text)
    return F.when(bare.rlike("[.!?。！？]$"), bare).otherwise(F.concat(bare, F.lit(".")))


def yes_no_question(question: Column, kind: str) -> Column:
    """The question with its allowed answers named."""
    return F.concat(question, F.lit({"truth": " (True or False)", "yes": " (Yes or No)"}[kind]))


def sentence_middle(text: Column) -> Column:
    """The first letter in lower case."""
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000_000))


def without_end(text: Column) -> Column:
    """The text without blanks and one end mark at its end."""
    return F.regexp_replace(F.rtrim(text), "[.!?。！？]$", "")


def after_blank(text: Column) -> Column:
    """With one blank in front, as the continuation of a prompt."""
    return F.concat(F.lit(" "), F.ltrim(text))


def continuation(context: Column, choices: Column, fix: bool = True) -> tuple[Column, Column]:
    """Prompt and continuations: the context as it is, each choice as what follows. With fix, a choice after a sentence's end begins a sentence, another one goes on."""
    context = F.rtrim(context)
    ended = context.rlike("[.!?。！？:]$")
    fitted = F.transform(choices, lambda c: F.when(ended, sentence_start(F.trim(c))).otherwise(sentence_middle(F.trim(c)))) if fix else choices
    return context, F.transform(fitted, after_blank)


#: What joins a premise with its cause or effect.
CONNECTIVES = {"cause": "because", "effect": "therefore"}


def cause_or_effect(premise: Column, kind: Column, choices: Column) -> tuple[Column, Column]:
    """A premise without its end mark and the connective of its kind; the choices go on in small letters."""
    word = F.create_map(*[F.lit(x) for pair in CONNECTIVES.items() for x in pair])[kind]
    return F.concat(without_end(premise), F.lit(" "), word), F.transform(choices, lambda c: after_blank(sentence_middle(F.trim(c))))


def blank_filled(sentence: Column, choices: Column, gap: str = "_") -> tuple[Column, Column]:
    """Completion of a sentence with a gap: the prompt ends before the gap, each choice is followed by the rest."""
    at = F.instr(sentence, gap)
    head, rest = F.rtrim(F.substring(sentence, F.lit(1), at - 1)), F.substring(sentence, at + len(gap), F.length(sentence))
    return F.when(at > 0, head).otherwise(F.rtrim(sentence)), F.transform(choices, lambda c: F.concat(F.lit(" "), F.trim(c), F.when(at > 0, rest).otherwise("")))


def entailment(premise: Column, hypothesis: Column) -> tuple[Column, Column]:
    """Whether one sentence follows from another, as a question with a tag: yes, also or no."""
    ask = F.concat(without_end(premise), F.lit(", right?"))
    return ask, F.transform(F.array(F.lit("Yes"), F.lit("Also"), F.lit("No")), lambda w: F.concat(F.lit(" "), w, F.lit(", "), sentence_middle(F.trim(hypothesis))))


def reading_question(context: Column, question: Column) -> Column:
    """A question about a text; without a text only the question."""
    asked = F.concat(F.lit("Question: "), F.trim(question), F.lit("\nAnswer:"))
    return F.when(F.trim(context) != "", F.concat(F.trim(context), F.lit("\n"), asked)).otherwise(asked)


def yes_no(context: Column, question: Column) -> tuple[Column, Column]:
    """A closed question about a text, with its two answers."""
    return reading_question(context, question), F.array(F.lit(" Yes"), F.lit(" No"))


def translation(source: Column, source_language: str, target_language: str) -> Column:
    """A text under its language's name, and the name of the language wanted."""
    return F.concat(F.lit(f"{source_language.upper()}: "), F.trim(source), F.lit(f"\n{target_language.upper()}:"))


def example_pair(row: DataFrame) -> tuple[Column, Column]:
    """text and target of a row of pairs; of a refined row the text it was made of and its chunks' programs. Outer blanks go."""
    has, first = set(row.columns), lambda *c: F.coalesce(*(F.col(x) for x in c if x in has), F.lit(""))
    if "target" in has:
        return F.trim(first("text")), F.trim(F.col("target"))
    program = F.col("metadata.chunk_program") if "metadata" in has else F.lit("")
    return F.trim(first("doc_content", "raw_content", "text")), F.trim(F.coalesce(program, F.lit("")))


def lettered_item(question: Column, choices: Column, letter: Column) -> Column:
    """query, choices (a blank in front) and gold_index of a row whose answer is a letter."""
    return F.struct(question.alias("query"), F.transform(choices, lambda c: F.concat(F.lit(" "), c)).alias("choices"), gold_from_letter(letter).cast("int").alias("gold_index"))


def numbered_item(context: Column, question: Column, choices: Column, number: Column) -> Column:
    """The same of a row with a context and an answer counted from 1."""
    return F.struct(F.concat_ws(" ", context, question).alias("query"), F.transform(choices, lambda c: F.concat(F.lit(" "), c)).alias("choices"), (number.cast("int") - 1).alias("gold_index"))


def ending_item(activity: Column, first: Column, second: Column, endings: Column, label: Column) -> Column:
    """The same of a how-to row: activity and the two parts of its context, cleaned, with possible endings; -1 without a label."""
    context = F.concat(activity, F.lit(": "), first, F.lit(" "), F.upper(F.substring(second, 1, 1)), F.lower(F.substring(second, 2, 1_000_000_000)), F.lit(" "))
    fitted = F.transform(endings, lambda e: F.concat(F.lit(" "), without_brackets(e)))
    return F.struct(without_brackets(context).alias("query"), fitted.alias("choices"), F.coalesce(F.when(F.trim(label) != "", label.try_cast("int")), F.lit(-1)).alias("gold_index"))
