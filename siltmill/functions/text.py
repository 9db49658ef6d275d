"""Scalar text functions: each takes and gives a Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame as DataFrame_
from pyspark.sql import functions as F

#: Fixed value: what stands between the outputs of a row's chunks in one string.
CHUNK_SEPARATOR = "\n\n### OPENROUTER_CHUNK_PROGRAM ###\n\n"
#: Fixed value: white space as Python's str.split() has it, as a regular expression.
WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"
#: Fixed value: line ends as Python's str.splitlines() has them.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def quoted(literal: str) -> str:
    """The literal as a regular expression of Java."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def filled(text: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(text, F.lit(""))


def lines(text: Column) -> Column:
    """Lines at line feeds only; the empty text has one."""
    return F.split(text, "\n", -1)


def line_label(number: Column) -> Column:
    """[000], wider from 1000 on."""
    digits = number.cast("string")
    return F.concat(F.lit("["), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")), F.lit("]"))


def labelled_lines(text: Column) -> Column:
    """Lines with their numbers in the whole text in front."""
    return F.transform(lines(text), lambda line, i: F.concat(line_label(i), line))


def line_count(text: Column) -> Column:
    """Lines as splitlines counts them: other line ends count too, nothing follows the last one."""
    parts = F.split(text, LINE_ENDS, -1)
    return (F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("bigint")


def words(text: Column) -> Column:
    """Words between white space of any kind, none empty."""
    return F.filter(F.split(text, WHITE_SPACE, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def token_estimate(text: Column) -> Column:
    """One token for four characters, rounded up, and one at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("bigint")


def first_filled(*columns: Column) -> Column:
    """The first that is not blank, else the empty string."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns), F.lit(""))


def without_separators(text: Column) -> Column:
    return F.replace(text, F.lit(CHUNK_SEPARATOR), F.lit(""))


def split_outputs(text: Column) -> Column:
    """Outputs of the chunks; none of the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, quoted(CHUNK_SEPARATOR), -1))


def join_outputs(outputs: Column) -> Column:
    return F.array_join(outputs, CHUNK_SEPARATOR)


def shortened(text: Column, size: int) -> Column:
    """The first characters and a mark, where there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(" …"))).otherwise(text)


def head_and_tail(text: Column, size: int) -> Column:
    """The first and the last half of the size with dots between, where the text is longer."""
    half = size // 2
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, half), F.lit("..."), F.right(text, F.lit(half)))).otherwise(text)


def without_punctuation(text: Column) -> Column:
    """Lower case without the ASCII punctuation."""
    return F.translate(F.lower(text), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")


def quiz_normal(text: Column) -> Column:
    """Lower case without punctuation and English articles, single blanks."""
    bare = F.regexp_replace(without_punctuation(text), r"\b(a|an|the)\b", " ")
    return F.array_join(words(bare), " ")


def without_brackets(text: Column) -> Column:
    """How-to text: ' [title]' ends a sentence, other bracketed parts go, two blanks become one."""
    titled = F.replace(text, F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(titled, r"\[[^\]]*\]", ""), F.lit("  "), F.lit(" "))


def final_number(text: Column) -> Column:
    """The number after four hashes, without thousands separators; [invalid] where there is none."""
    found = F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1)
    return F.when(found == "", "[invalid]").otherwise(F.replace(F.trim(found), F.lit(","), F.lit("")))


def without_tags(text: Column, *pairs: tuple[str, str]) -> Column:
    """The text without the stretches between the tags of each pair, tags included. The first start tag that no end tag follows ends the pair's turn; what
    stands before it, such as an end tag of nothing, stays."""
    for start, end in pairs:
        text = F.regexp_replace(text, f"(?s){quoted(start)}.*?{quoted(end)}", "")
    return text


def token_budget(characters: Column, per_token: float) -> Column:
    """Tokens that a number of characters is expected to give."""
    if per_token <= 0:
        raise ValueError("characters per token must be above 0")
    return F.floor(characters / F.lit(float(per_token))).cast("bigint")


def spaced_stops(text: Column) -> Column:
    """A stop between blanks ends its line."""
    return F.replace(text, F.lit(" . "), F.lit(".\n"))


def without_braces(text: Column, strip: bool = False) -> Column:
    """The text without an opening brace at its start and a closing one at its end; with strip, without outer blanks first."""
    text = F.regexp_replace(text, f"^{WHITE_SPACE}|{WHITE_SPACE}$", "") if strip else text
    return F.regexp_replace(F.regexp_replace(text, r"\A\{", ""), r"\}\z", "")


#: Articles by language.
ARTICLES = {
    "en": "a|an|the",
    "es": "el|la|los|las|un|una|unos|unas",
    "pt": "o|a|os|as|um|uma|uns|umas",
    "it": "il|lo|la|i|gli|le|un|uno|una",
    "fr": "le|la|les|l'|un|une|des",
    "de": "der|die|das|den|dem|des|ein|eine|einer|eines|einem|einen",
    "fi": "se|yksi|yks",
    "el": "ὁ|οἱ|τοῦ|τῶν|τόν|τούς|ὦ|ἡ|αἱ|τῆς|τῶν|τήν|τάς|τό|τά|τοῦ|τῶν|τό|τά",
    "no": "en|ei|et|den|det|de",
    "sv": "en|ett|den|det|de",
    "tr": "bir",
    "nl": "de|het|een",
    "hu": "a|az|egy",
    "ca": "el|la|els|les|un|una|uns|unes",
    "he": "ה",
    "gl": "o|a|os|as|un|unha|uns|unhas",
}


def without_articles(text: Column, language: str) -> Column:
    """The articles of the language as blanks; of a language without a list nothing goes."""
    return F.regexp_replace(text, rf"(?U)\b({ARTICLES[language]})\b", " ") if language in ARTICLES else text


def answer_normal(text: Column, language: str, lower: bool = True) -> Column:
    """An answer without articles and punctuation of any script, in small letters, single blanks between words."""
    bare = F.regexp_replace(without_articles(text, language), r"[\p{P}$+<=>^`|~]", "")
    return F.array_join(words(F.lower(bare) if lower else bare), " ")


def output_text(row: DataFrame_, is_code: bool = False) -> Column:
    """Text of an output row: the first of text, programs_delimited and raw_content that is not blank, else the programs joined, else the row as JSON.
    For code the programs come first."""
    has = set(row.columns)
    single = [F.col(c) for c in ("text", "programs_delimited", "raw_content") if c in has]
    joined = F.array_join("programs", "\n\n") if "programs" in has else F.lit("")
    order = [joined, *single] if is_code else [*single, joined]
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in order), F.to_json(F.struct(*row.columns)))


def joined_chat_content(content: Column) -> Column:
    """Text of a chat message given as JSON: a string, or a list of strings and text blocks; null is empty."""
    blocks = F.from_json(content, "array<string>")
    block = lambda b: F.coalesce(F.get_json_object(b, "$.text"), F.when(F.startswith(b, F.lit("{")), F.lit("")).otherwise(b))
    return F.coalesce(F.when(F.startswith(content, F.lit("[")), F.array_join(F.transform(blocks, block), "")), content, F.lit(""))


#: What tokenised encyclopedia text has, and what it was, in the order in which they are undone.
DETOKENISED = (
    ("s '", "s'"), (" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", "."), (" : ", ": "), (" ; ", "; "), (" . ", ". "), (" ! ", "! "), (" ? ", "? "), (" , ", ", "),
    ("( )", ""), ("[ ]", ""), ("{ }", ""), ('" "', ""), ("' '", ""),
    ("= = = =", "===="), ("= = =", "==="), ("= =", "=="), (" ° ", "°"), (" \n", "\n"), ("\n ", "\n"), (" N ", " 1 "), (" 's", "'s"),
)


def plain_sentences(text: Column) -> Column:
    """Tokenised encyclopedia text made readable. A rule of two marks with a blank between them takes the blanks inside such a pair away."""
    for written, plain in DETOKENISED:
        if plain:
            text = F.replace(text, F.lit(written), F.lit(plain))
        else:
            opening, closing = written[0], written[-1]
            pattern = rf"{quoted(opening)}\s*([^{quoted(closing)}]*?)\s*{quoted(closing)}"
            text = F.regexp_replace(text, f"(?U){pattern}", rf"\{opening}$1\{closing}")
    return text
