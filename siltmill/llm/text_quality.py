"""Problem 1: statistics of each text, and from them whether it is natural prose.

A line is prose, list, table or junk by combined rules on its own counts (share of common words, symbols, shape of
its start and end) and on the text around it (runs of entries, paragraphs broken into lines). A text most of which is
said again, by its lines, paragraphs, runs of four words or one pair of words, is junk. A text is not prose where most of
its visible characters lie in lines that are not prose.

Results: null and blank texts have zero counts, kind "empty" and are never cases. Equal rows get equal results; the
order of rows, columns beside the two read and their names make no difference. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .line_shape import LineShape
from .text_batch import LETTER, MARK, SPACE, TextBlock, blocks

PROSE, LIST, TABLE, JUNK, BLANK = 0, 1, 2, 3, 4
KIND_NAMES = np.array(["prose", "list", "table", "junk", "empty"], object)

STATS = {
    "chars": "bigint", "words": "bigint", "lines": "bigint", "mean_word_length": "double", "symbol_ratio": "double", "line_end_share": "double", "common_word_share": "double", "bullet_share": "double",
    "duplicate_line_share": "double", "duplicate_paragraph_share": "double", "top_bigram_share": "double", "duplicate_ngram_share": "double", "prose_share": "double", "kind": "string", "is_prose": "boolean",
}


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a), float), where=np.asarray(b) > 0)


def ngram_repetition(block: TextBlock, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's word n-grams: the share (in characters) of the most frequent one, if it repeats, and the share of those that occurred before."""
    texts, hashes = len(block), block.word_hash
    top, again = np.zeros(texts), np.zeros(texts)
    m = len(hashes) - n + 1
    if m <= 0:
        return top, again
    of = block.word_text[:m]
    inside = of == block.word_text[n - 1 :]
    key = hashes[:m].copy()
    for i in range(1, n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    key = (key + of.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.flatnonzero(inside)
    if not len(at):
        return top, again
    _, first, count = np.unique(key[at], return_index=True, return_counts=True)
    first = at[first]
    size = block.word_end[first + n - 1] - block.word_start[first]
    total = np.bincount(of[at], minlength=texts)
    again = _ratio(total - np.bincount(of[first], minlength=texts), total)
    covered = np.where(count > 1, count * size, 0)
    np.maximum.at(top, of[first], covered)
    chars = np.maximum(block.text_end - block.text_start, 1)
    return np.minimum(top / chars, 1.0), again


class Repetition:
    """How far each text repeats itself, and whether it does so mostly: by any of the four shares."""

    def __init__(self, block: TextBlock, shape: LineShape):
        texts, add = len(block), block.sum_lines
        filled, words = add(~shape.blank), add(shape.words)
        self.bigram, _ = ngram_repetition(block, 2)
        _, self.ngrams = ngram_repetition(block, 4)
        # lines and paragraphs that stood in the text before
        seen = (shape.hashes + shape.text.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        at = np.flatnonzero(~shape.blank)
        new = np.zeros(len(seen), bool)
        new[at[np.unique(seen[at], return_index=True)[1]]] = True
        self.lines = _ratio(add(~shape.blank & ~new), filled)
        opens = ~shape.blank & np.concatenate(([True], shape.blank[:-1] | (shape.text[1:] != shape.text[:-1])))
        begin = np.flatnonzero(opens)
        paragraphs, again = np.zeros(texts), np.zeros(texts)
        if len(begin):
            parts = np.add.reduceat(np.where(shape.blank, np.uint64(0), shape.hashes), begin)
            parts = (parts + shape.text[begin].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            once = np.zeros(len(parts), bool)
            once[np.unique(parts, return_index=True)[1]] = True
            paragraphs = np.bincount(shape.text[begin], minlength=texts)
            again = np.bincount(shape.text[begin[~once]], minlength=texts)
        self.paragraphs = _ratio(again, paragraphs)
        enough = words >= 12
        self.again = enough & (self.ngrams > 0.55)
        self.repeated = enough & ((self.bigram > 0.4) | (self.lines > 0.7) & (filled >= 6) | (self.paragraphs > 0.7) & (paragraphs >= 6))


def line_kinds(shape: LineShape, repetition: Repetition) -> np.ndarray:
    """Kind of each line. In texts that mostly say the same words again all lines are junk, in those that repeat lines, paragraphs or a pair of words the prose is."""
    s, b = shape, shape.block
    chars, words = np.maximum(s.chars, 1), np.maximum(s.words, 1)
    common = s.common / words
    letters = s.letters / chars
    # scripts other than Latin, some of which set no blanks between words
    other_script = s.other_script > 0.5 * np.maximum(s.letters, 1)
    longest = np.where(other_script, 5, s.letters / words)  # mean letters of a word
    table = ~s.blank & ~s.ends & ((s.cells >= 2) & (common < 0.2) & (s.digits > 0) | (s.digits > 0.25 * chars) & (s.words > 1) & (common < 0.15) & (longest < 12))
    junk = (letters < 0.55) & (s.strange + s.digits > 0.3 * chars) | (s.strange > 0.07 * chars) | (longest > 16) | (s.digits > 0.12 * chars) & (longest > 10) | (s.words == 0) & ~s.blank
    # Entries stand in runs of short lines without a full stop, none of which goes on in lower case.
    short = ~s.blank & ~s.ends & (s.chars <= 75)
    texts = len(b)
    filled = np.maximum(np.bincount(s.text[~s.blank], minlength=texts), 1)
    lower = np.bincount(s.text[s.lower_start & (s.words >= 3)], minlength=texts) / filled
    wrapped = (lower >= 0.2)[s.text]
    before = np.concatenate(([False], (s.text[1:] == s.text[:-1]) & ~s.blank[:-1]))
    after = np.concatenate((before[1:] & ~s.blank[1:], [False]))
    neighbour = np.zeros(len(short), bool)
    neighbour[1:] |= short[:-1] & (s.text[1:] == s.text[:-1])
    neighbour[:-1] |= short[1:] & (s.text[1:] == s.text[:-1])
    entry = short & (s.bullet & (s.words <= 12) | s.titled & (s.words <= 14) & ~wrapped | neighbour & ~wrapped & (s.words <= 12))
    # In wrapped prose a line is judged with the lines next to it.
    around, size = s.common.astype(float), s.words.astype(float)
    for there, move in ((before, 1), (after, -1)):
        around += np.where(there & wrapped, np.roll(s.common, move), 0)
        size += np.where(there & wrapped, np.roll(s.words, move), 0)
    around /= np.maximum(size, 1)
    prose = (around >= 0.12) & ((s.words >= 3) | wrapped) | (common >= 0.07) & (s.words >= 9)
    # A language without words in the list: long sentences of ordinary length words with an end.
    foreign = s.ends & (s.words >= 10) & (letters > 0.8) & (s.common == 0) & ~s.lower_start
    foreign |= other_script & (letters > 0.7) & ((s.words >= 6) | (s.chars >= 20))
    # The same for paragraphs that are broken into lines: their lines together.
    opens = ~s.blank & ~before
    if opens.any():
        paragraph = np.maximum(np.cumsum(opens) - 1, 0)
        of = paragraph[~s.blank]
        total = lambda values: np.bincount(of, values[~s.blank], minlength=int(paragraph[-1]) + 1)[paragraph]
        size, signs = total(s.words), total(s.chars)
        plain = (total(s.bullet) == 0) & (total(s.letters) > 0.8 * signs) & (total(s.common) < 0.07 * size) & (total(s.cells) == 0) & (signs < 13 * size)
        # like a sentence, it begins with no small letter and ends with a mark
        closes = ~s.blank & ~after
        whole = (total(opens & s.lower_start) == 0) & (total(closes & s.ends) > 0)
        foreign |= wrapped & ~s.blank & plain & whole & (size >= 10)
    kinds = np.where(prose | foreign, PROSE, LIST)
    kinds[entry & ~(foreign & wrapped)] = LIST
    kinds[junk] = JUNK
    kinds[table & ~(s.strange > 0.07 * chars)] = TABLE
    kinds[repetition.again[s.text] | repetition.repeated[s.text] & (kinds == PROSE)] = JUNK
    kinds[s.blank] = BLANK
    return kinds


def block_stats(block: TextBlock, full: bool = True) -> dict[str, np.ndarray]:
    """The columns of STATS for each text of the block; of those only kind and is_prose if not full."""
    shape, texts = LineShape(block), len(block)
    add = block.sum_lines
    chars, words, filled = add(shape.chars), add(shape.words), add(~shape.blank)
    repetition = Repetition(block, shape)
    kinds = line_kinds(shape, repetition)
    prose = add(shape.chars * (kinds == PROSE))
    by_kind = np.stack([add(shape.chars * (kinds == k)) for k in (PROSE, LIST, TABLE, JUNK)])
    kind = np.where(chars == 0, BLANK, np.where(prose * 2 >= chars, PROSE, 1 + by_kind[1:].argmax(0)))
    if not full:
        return {"kind": KIND_NAMES[kind], "is_prose": kind == PROSE}
    letters = add(shape.letters)
    visible = block.kinds != SPACE
    symbols = np.add.reduceat((visible & (block.kinds != LETTER) & (block.kinds != MARK)).astype(np.int64), block.text_start) if texts else np.zeros(0)
    return {
        "chars": block.text_end - block.text_start, "words": words.astype(np.int64), "lines": np.diff(block.first_line), "mean_word_length": _ratio(letters, words), "symbol_ratio": _ratio(symbols, chars),
        "line_end_share": _ratio(add(shape.ends), filled), "common_word_share": _ratio(add(shape.common), words), "bullet_share": _ratio(add(shape.bullet), filled),
        "duplicate_line_share": repetition.lines, "duplicate_paragraph_share": repetition.paragraphs, "top_bigram_share": repetition.bigram, "duplicate_ngram_share": repetition.ngrams,
        "prose_share": _ratio(prose, chars), "kind": KIND_NAMES[kind], "is_prose": kind == PROSE,
    }


def junk_texts(block: TextBlock, shape: LineShape) -> np.ndarray:
    """The texts most of whose characters are junk."""
    kinds = line_kinds(shape, Repetition(block, shape))
    return block.sum_lines(shape.chars * (kinds == JUNK)) * 2 > block.sum_lines(shape.chars)


def text_statistics(df: DataFrame, key: str, text: str, columns: list[str] | None = None) -> DataFrame:
    """key and the statistics (all of STATS, or the columns given) of the text of every row. No shuffle."""
    columns = columns or list(STATS)
    full = not {"kind", "is_prose"}.issuperset(columns)
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, part in blocks(texts):
                found = block_stats(TextBlock(part), full)
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(part)), *(pa.array(found[c], kinds[STATS[c]]) for c in columns)], ["key", *columns])

    schema = f"key {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {STATS[c]}" for c in columns)
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def not_prose(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the rows whose text is mostly list, table or junk."""
    found = text_statistics(df, key, text, ["is_prose", "kind"])
    return found.where("NOT is_prose AND kind <> 'empty'").select(key)
