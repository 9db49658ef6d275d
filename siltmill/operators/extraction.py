"""Answers, outputs and statistics taken out of texts; aggregates over whole corpora of answers."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions.text import words
from .scores import BOXED, NUMBER, ngrams, shared_ngrams


def output_blocks(transcript: Column) -> Column:
    """Contents of the fenced output blocks of an interleaved transcript."""
    return F.regexp_extract_all(transcript, F.lit(r"(?s)```output\n(.*?)\n?```"), 1)


def code_blocks(transcript: Column) -> Column:
    """Contents of the fenced Python blocks."""
    return F.regexp_extract_all(transcript, F.lit(r"(?s)```(?:python|py)\n(.*?)\n?```"), 1)


#: What an output says when its program failed.
FAILURES = ("error", "exception", "no algorithms", "cannot", "nan", "...")


def transcript_parts(text: str) -> list[tuple[str, str]] | None:
    """Rationales, programs and outputs of a transcript in turn, each with the line ends it has; None where the fences do not fit together."""
    parts: list[tuple[str, str]] = []
    role, held = "rationale", ""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        opens, closes, reports = line == "```python", line == "```", line.startswith("```output")
        if opens and role != "rationale" or closes and role == "program" and not held or reports and role == "output" and held:
            return None
        if opens or closes and role != "rationale":
            if held or role == "output":
                parts.append((role, held))
            role, held = {"rationale": "program", "program": "output", "output": "rationale"}[role], ""
        elif not (reports and role == "output"):
            held += line + "\n" * (i < len(lines) - 1)
    return [*parts, (role, held)] if held else parts


def transcript_program(text: str, last_only: bool = False) -> str:
    """One program out of a transcript's: of those that failed only the imports, of all but the last no lines that print. "" where the fences do not fit."""
    parts = transcript_parts(text) or []
    programs, imports = [], []
    for i, (role, content) in enumerate(parts):
        if role == "program":
            output = parts[i + 1][1].lower() if i + 1 < len(parts) else ""
            if any(x in output for x in FAILURES):
                imports += [x for x in content.split("\n") if x.startswith(("import", "from"))]
            else:
                programs.append(content)
    programs = programs or [""]
    if imports:
        programs[0] = "\n".join([*imports, programs[0]])
    quiet = ["\n".join(x for x in p.split("\n") if not x.strip().startswith("print(")) for p in programs[:-1]]
    return programs[-1] if last_only else "\n".join([*quiet, programs[-1]])


@F.pandas_udf(K.StringType())
def program_of(transcripts: pd.Series) -> pd.Series:
    """transcript_program of a column; null is empty."""
    return pd.Series([transcript_program(t or "") for t in transcripts], dtype=object)


def ground_truth(answer: Column, form: str) -> Column:
    """The gold answer of a data row by the form in which its data set has it."""
    if form == "hashes":  # a worked solution ending in #### and the answer
        return F.replace(F.trim(F.element_at(F.split(answer, "####", -1), -1)), F.lit(","), F.lit(""))
    if form == "options":  # the letter of an option
        return F.upper(F.regexp_extract(answer, r"\(?\s*([A-Za-z])\s*\)?", 1))
    if form == "number":
        return F.replace(F.regexp_extract(answer, NUMBER, 0), F.lit(","), F.lit(""))
    if form == "boxed":  # the last answer box of a worked solution
        boxed = F.regexp_extract_all(answer, F.lit(BOXED), 1)
        return F.coalesce(F.element_at(F.when(F.size(boxed) > 0, boxed), -1), F.lit(""))
    if form == "bracketed_number":  # a number followed by its unit in brackets
        return F.replace(F.regexp_replace(F.trim(answer), r"\s*\([^()]*\)$", ""), F.lit(","), F.lit(""))
    if form == "index":  # the index of an option
        return F.char(answer.cast("int") + 65)
    if form == "truth":
        return F.when(F.lower(F.trim(answer)).isin("true", "1", "yes"), "True").otherwise("False")
    if form == "plain":
        return F.trim(answer)
    raise ValueError(f"unknown form {form!r}")


#: Fixed value: what stands between a question and its options where an explanation is wanted.
EXPLAINED = "\nWhat of the following is the right choice? Explain your answer.\n"


def _bracketed(options: Column, letters: str) -> Column:
    """Options in one string, 'A) first B) second', with their letters in brackets."""
    for letter in letters:
        options = F.replace(options, F.lit(f" {letter}) "), F.lit(f" ({letter}) "))
    return F.concat(F.lit("("), options)


def _listed_options(options: Column, letters: str = "abcde") -> Column:
    """Options in one string, 'a ) first , b ) second', or a list of such strings written as JSON or with single quotes; nothing in it is ever evaluated."""
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(options, r"^\[ *'", '["'), r"' *\]$", '"]'), "' *, *'", '", "')
    text = F.when(F.startswith(options, F.lit("[")), F.array_join(F.from_json(json, "array<string>"), ", ")).otherwise(options)
    for letter in letters:
        text = F.replace(F.replace(text, F.lit(f"{letter} ) {letter} ) "), F.lit(f"{letter} ) ")), F.lit(f"{letter} ) "), F.lit(f"({letter.upper()}) "))
    return F.replace(text, F.lit(" , "), F.lit(", "))


def question(row: dict[str, Column], form: str) -> Column:
    """The question put together from a row's columns by the form of its data set; nothing in the row is ever evaluated."""
    if form == "body":
        return F.concat_ws(" ", F.trim(row["body"]), F.trim(row["question"]))
    if form == "stopped_body":  # the body ends with a stop
        body = F.trim(row["body"])
        return F.concat(F.when(F.endswith(body, F.lit(".")), body).otherwise(F.concat(body, F.lit("."))), F.lit(" "), F.trim(row["question"]))
    if form == "options":
        listed = F.array_join(F.transform(row["options"], lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), o)), " ")
        return F.concat(F.trim(row["question"]), F.lit("\nAnswer Choices: "), listed)
    if form == "explained_options":
        listed = F.array_join(F.transform(row["options"], lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), F.trim(o))), ", ")
        return F.concat(F.trim(row["question"]), F.lit(EXPLAINED), listed)
    if form == "option_string":  # A) first B) second
        return F.concat(F.trim(row["question"]), F.lit(EXPLAINED), F.trim(_bracketed(F.trim(row["options"]), "BCD")))
    if form == "option_list":  # a ) first , b ) second
        problem = F.trim(row["question"])
        return F.concat(F.upper(F.substring(problem, 1, 1)), F.substring(problem, 2, 1_000_000_000), F.lit(EXPLAINED), F.trim(_listed_options(F.trim(row["options"]))))
    if form == "table":
        asked = F.concat(F.lit("Read the following table "), F.when(row["title"] != "", F.concat(F.lit('regarding "'), row["title"], F.lit('" '))).otherwise(""), F.lit("and answer a question:\n"), row["table"], F.lit("\n"), row["question"])
        choices = row.get("options")
        return asked if choices is None else F.when(F.size(choices) > 0, F.concat(asked, F.lit(" Please select from the following options: "), F.to_json(choices))).otherwise(asked)
    if form == "theorem":
        return F.concat(F.trim(row["question"]), F.lit("\nTheorem: "), F.trim(row["theorem"]))
    if form == "first":  # the first column of several that has something
        return F.trim(F.coalesce(*(F.when(F.trim(c) != "", c) for c in row.values()), F.lit("")))
    if form == "plain":
        return F.trim(row["question"])
    raise ValueError(f"unknown form {form!r}")


def closed_question(asked: Column, truth: Column) -> Column:
    """The question with its two answers named, where the truth is one of such a pair."""
    bare = F.lower(F.trim(truth))
    return F.trim(F.concat(asked, F.when(bare.isin("true", "false"), " (True or False)").when(bare.isin("yes", "no"), " (Yes or No)").otherwise("")))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The last match of the first pattern that matches at all (its first group), else the empty string."""
    out = F.lit("")
    for p in reversed(patterns):
        found = F.regexp_extract_all(text, F.lit(p), 1)
        out = F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(out)
    return out


_UNITS = re.compile(r"\\(?:text|mbox|mathrm)\{\s*(?:cm|mm|km|m|kg|g|s|h|hours?|minutes?|degrees?|units?|dollars?|cents?|feet|inches|miles|percent)[^{}]*\}(?:\^\{?[0-9]\}?)?")
_BARE_FRACTION = re.compile(r"\\frac\s*(?:\{([^{}]*)\}|(\w))\s*(?:\{([^{}]*)\}|(\w))")
_SLASHED = re.compile(r"(?<![\w/])(-?\d+)/(\d+)(?![\w/])")


def plain_latex(text: str) -> str:
    """One spelling of a short mathematical answer: no delimiters, spacing, units or degree signs; fractions and roots with braces."""
    out = text.strip().rstrip(".").strip("$").replace("\\!", "").replace("\\,", "").replace("\\ ", "").replace("\\left", "").replace("\\right", "").replace("\\$", "").replace("\\%", "").replace("%", "")
    out = re.sub(r"\^\{?\\circ\}?", "", out).replace("dfrac", "frac").replace("tfrac", "frac")
    out = _UNITS.sub("", out)
    out = re.sub(r"\\(?:text|mbox|mathrm)\{([^{}]*)\}", r"\1", out)
    out = _BARE_FRACTION.sub(lambda m: f"\\frac{{{m[1] if m[1] is not None else m[2]}}}{{{m[3] if m[3] is not None else m[4]}}}", out)
    out = re.sub(r"\\sqrt\s*(\w)", r"\\sqrt{\1}", out)
    out = _SLASHED.sub(r"\\frac{\1}{\2}", out)
    out = re.sub(r"^\w\s*=\s*", "", out)
    out = re.sub(r"(?<!\d)\.(\d)", r"0.\1", out)
    out = re.sub(r"(\d)\.0+(?!\d)", r"\1", out)
    return re.sub(r"\s+", "", out).rstrip(".")


def latex_normal(answer: Column | str) -> Column:
    """The same inside the JVM."""
    out = F.coalesce(F.col(answer) if isinstance(answer, str) else answer, F.lit(""))
    change = lambda pattern, to: F.regexp_replace(out, f"(?U){pattern}", to)
    out = change(r"^\s+|\s+$", "")
    out = change(r"\.+$", "")
    out = change(r"^\$+|\$+$", "")
    for gone in ("\\!", "\\,", "\\ ", "\\left", "\\right", "\\$", "\\%", "%"):
        out = F.replace(out, F.lit(gone), F.lit(""))
    out = change(r"\^\{?\\circ\}?", "")
    out = F.replace(F.replace(out, F.lit("dfrac"), F.lit("frac")), F.lit("tfrac"), F.lit("frac"))
    out = change(_UNITS.pattern, "")
    out = change(r"\\(?:text|mbox|mathrm)\{([^{}]*)\}", "$1")
    out = change(_BARE_FRACTION.pattern, r"\\frac{$1$2}{$3$4}")
    out = change(r"\\sqrt\s*(\w)", r"\\sqrt{$1}")
    out = change(_SLASHED.pattern, r"\\frac{$1}{$2}")
    out = change(r"^\w\s*=\s*", "")
    out = change(r"(?<!\d)\.(\d)", "0.$1")
    out = change(r"(\d)\.0+(?!\d)", "$1")
    out = change(r"\s+", "")
    return change(r"\.+$", "")


def greedy_fragments(source: list[str], summary: list[str]) -> list[int]:
    """Lengths of the longest stretches of the source of which the summary is made up, found from left to right."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(source):
        places.setdefault(w, []).append(i)
    out, at = [], 0
    while at < len(summary):
        best = 0
        for i in places.get(summary[at], ()):
            n = 0
            while at + n < len(summary) and i + n < len(source) and summary[at + n] == source[i + n]:
                n += 1
            best = max(best, n)
        if best:
            out.append(best)
        at += max(best, 1)
    return out


def extractive_statistics(df: DataFrame, key: str, source: str, summary: str) -> DataFrame:
    """key, coverage (share of the summary that is copied), density (mean copied length weighted by length) and compression (how much longer the source is) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, y = (a or "").split(), (b or "").split()
                f = greedy_fragments(x, y)
                rows.append((sum(f) / len(y), sum(n * n for n in f) / len(y), len(x) / len(y)) if y else (0.0, 0.0, 0.0))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["key", "coverage", "density", "compression"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), source, summary).mapInArrow(run, f"key {kind}, coverage double, density double, compression double").withColumnRenamed("key", key)


def numbered_text(lines: Column, tokens: Column, most: int) -> Column:
    """Labelled lines joined until the token sum would pass the limit; that line is cut to the tokens left (four characters each).

    The sums are carried along in one pass; lines behind the limit are not looked at, as each has a token at least.
    """
    rows = F.zip_with(F.slice(lines, 1, most), F.slice(tokens, 1, most), lambda x, t: F.struct(x.alias("x"), t.cast("bigint").alias("t")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("bigint").alias("sum"))

    def add(s: Column, r: Column) -> Column:
        left = most - s["sum"]
        line = F.when(r["t"] <= left, r["x"]).otherwise(F.substring(r["x"], F.lit(1), (left * 4).cast("int")))
        return F.struct(F.when(left > 0, F.concat(s["kept"], F.array(line))).otherwise(s["kept"]).alias("kept"), (s["sum"] + r["t"]).alias("sum"))

    return F.array_join(F.aggregate(rows, start, add, lambda s: s["kept"]), "\n")


def corpus_bleu(pairs: DataFrame, gold: str, prediction: str, orders: int = 4) -> DataFrame:
    """Corpus BLEU without smoothing: clipped n-gram counts are summed over all rows, so nothing is gathered."""
    g, p = words(F.col(gold)), words(F.col(prediction))
    sums = []
    for n in range(1, orders + 1):
        sums += [F.sum(shared_ngrams(ngrams(g, n), ngrams(p, n))).alias(f"hit{n}"), F.sum(F.size(ngrams(p, n))).alias(f"all{n}")]
    total = pairs.agg(F.sum(F.size(g)).alias("gold_words"), F.sum(F.size(p)).alias("words"), *sums)
    mean = sum((F.log(F.try_divide(F.col(f"hit{n}").cast("double"), F.col(f"all{n}").cast("double"))) for n in range(1, orders + 1)), F.lit(0.0)) / orders
    penalty = F.when(F.col("words") > F.col("gold_words"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("gold_words").cast("double"), F.col("words").cast("double"))))
    none = F.least(*(F.col(f"hit{n}") for n in range(1, orders + 1))) == 0
    return total.select("gold_words", "words", F.when(none, 0.0).otherwise(100 * penalty * F.exp(mean)).alias("bleu"))


def _character_statistics(gold: str, prediction: str, characters: int, words_: int) -> list[int]:
    """For each order of n-grams (of characters without white space, then of words and punctuation) those of the prediction, of the gold, and shared."""
    a, b = ("".join(x.split()) for x in (gold, prediction))
    out: list[int] = []

    def add(x, y, n: int) -> None:
        p, q = (Counter(tuple(z[i : i + n]) for i in range(len(z) - n + 1)) for z in (y, x))
        out.extend((p.total(), q.total(), (p & q).total()))

    for n in range(1, characters + 1):
        add(a, b, n)
    if words_:
        x, y = (_split_punctuation(t) for t in (gold, prediction))
        for n in range(1, words_ + 1):
            add(x, y, n)
    return out


def _split_punctuation(text: str) -> list[str]:
    """Words, with one punctuation mark at their end, else at their start, as a word of its own."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def corpus_chrf(pairs: DataFrame, gold: str, prediction: str, characters: int = 6, words_: int = 0, beta: float = 2.0) -> DataFrame:
    """Character n-gram F-score of a corpus (words_=2 for chrF++), from 0 to 100: counts of each order are summed over all rows; precision and recall are
    means over the orders that both sides have. Nothing but the sums is gathered."""
    orders = characters + words_

    @F.pandas_udf(K.ArrayType(K.LongType()))
    def statistics(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_character_statistics(x or "", y or "", characters, words_) for x, y in zip(a, b)])

    counted = pairs.select(statistics(gold, prediction).alias("s"))
    sums = counted.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0)).alias(f"s{i}") for i in range(3 * orders)))
    have = [(F.col(f"s{3 * n}") > 0) & (F.col(f"s{3 * n + 1}") > 0) for n in range(orders)]
    used = sum((h.cast("int") for h in have), F.lit(0))
    mean = lambda k: F.coalesce(F.try_divide(sum((F.when(have[n], F.col(f"s{3 * n + 2}") / F.col(f"s{3 * n + k}")).otherwise(0.0) for n in range(orders)), F.lit(0.0)), used.cast("double")), F.lit(0.0))
    done = sums.select("rows", mean(0).alias("precision"), mean(1).alias("recall"))
    score = F.try_divide((1 + beta**2) * F.col("precision") * F.col("recall"), beta**2 * F.col("precision") + F.col("recall"))
    return done.select("rows", "precision", "recall", (100 * F.coalesce(score, F.lit(0.0))).alias("chrf"))


def class_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """F1 of each class against the rest, and their plain and weighted means."""
    pairs = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    t, g, n, none = F.col(truth), F.col(guess), F.col("n"), F.lit(0).cast("bigint")
    part = lambda c, tp, fp, fn: F.struct(c.alias("c"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    parts = F.when(t == g, F.array(part(t, n, none, none))).otherwise(F.array(part(t, none, none, n), part(g, none, n, none)))
    each = pairs.select(F.explode(parts).alias("x")).groupBy("x.c").agg(F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    each = each.withColumn("f1", f1).withColumn("support", F.col("tp") + F.col("fn"))
    means = each.agg(F.avg("f1").alias("macro"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("weighted"), (F.sum("tp") / (F.sum("tp") + F.sum("fn"))).alias("micro"))
    return means


def cut_warnings(finish_reason: Column) -> Column:
    """Whether the model stopped at its limit."""
    return F.coalesce(F.lower(F.trim(finish_reason)).isin("length", "max_tokens"), F.lit(False))
