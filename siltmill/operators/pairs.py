"""Joins of inputs with outputs, supervised pairs, masks, labels and padding."""

from __future__ import annotations

import difflib
import html
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions.text import filled, without_separators

IGNORED = -100


def paired_rows(inputs: DataFrame, outputs: DataFrame, key: list[str], input_text: str, output_text: str, raw: DataFrame | None = None, raw_text: str | None = None) -> DataFrame:
    """key, reference and output of the rows on both sides; the reference is the raw text where there is one."""
    both = inputs.select(*key, F.col(input_text).alias("reference")).join(outputs.select(*key, F.col(output_text).alias("output")), key)
    if raw is None:
        return both
    third = raw.select(*key, F.col(raw_text).alias("_raw"))
    return both.join(third, key, "left").withColumn("reference", F.coalesce("_raw", "reference")).drop("_raw")


def with_misses(outputs: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """The outputs with has_source: whether the source row is there. Kept as rows, so that misses can be counted by anything."""
    known = sources.select(*key).distinct().withColumn("has_source", F.lit(True))
    return outputs.join(known, key, "left").na.fill({"has_source": False})


def chunk_pairs(df: DataFrame, inputs: str, outputs: str) -> DataFrame:
    """A row for each chunk of the documents whose arrays of inputs and outputs have one length: chunk, text, target."""
    same = df.where(F.size(inputs) == F.size(outputs)).withColumn("_pair", F.arrays_zip(F.col(inputs).alias("text"), F.col(outputs).alias("target")))
    rest = [c for c in df.columns if c not in (inputs, outputs)]
    return same.select(*rest, F.posexplode("_pair").alias("chunk", "_p")).select(*rest, "chunk", F.col("_p.text").alias("text"), F.col("_p.target").alias("target"))


def with_end(target: Column, end: str) -> Column:
    """The target with the end token's string behind it, unless it is there."""
    return F.when(F.endswith(target, F.lit(end)), target).otherwise(F.concat(target, F.lit(end)))


#: Characters that are counted at a time.
CHARACTERS = 4_000_000


def _shared_characters(a: list[str], b: list[str]) -> np.ndarray:
    """Size of the intersection of the two strings' multisets of characters, for each pair."""

    def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        return np.unique(rows << 21 | codes, return_counts=True)

    (x, n), (y, m) = counted(a), counted(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return np.bincount(x[i] >> 21, np.minimum(n[i], m[j]), minlength=len(a))


@F.pandas_udf(K.DoubleType())
def dissimilarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """(1 - quick ratio) times the summed lengths: what the two strings' characters, as multisets, do not share. Counted for many rows at once."""
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64)
    shared = np.zeros(len(x))
    begin = 0
    while begin < len(x):
        end = max(begin + 1, int(np.searchsorted(np.cumsum(total[begin:]), CHARACTERS)) + begin)
        shared[begin:end] = _shared_characters(x[begin:end], y[begin:end])
        begin = end
    return pd.Series(total - 2.0 * shared)


def character_keep_mask(reference: str, output: str) -> str:
    """For each character of the reference 1 if the sequence matcher finds it in the output, else 0."""
    if reference == output:
        return "1" * len(reference)
    mask = bytearray(b"0" * len(reference))
    for i, _, n in difflib.SequenceMatcher(None, reference, output, autojunk=False).get_matching_blocks():
        mask[i : i + n] = b"1" * n
    return mask.decode()


def keep_masks(df: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """key, chars and mask of every row. For chunks, not for whole books: the matcher's time can grow with the square of the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [character_keep_mask(x or "", y or "") for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, masks), pa.int64()), pa.array(masks, pa.string())], ["key", "chars", "mask"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), reference, output).mapInArrow(run, f"key {kind}, chars bigint, mask string").withColumnRenamed("key", key)


@F.pandas_udf(K.StringType())
def keep_mask_of(reference: pd.Series, output: pd.Series) -> pd.Series:
    """character_keep_mask of two columns; null is empty."""
    return pd.Series([character_keep_mask(x or "", y or "") for x, y in zip(reference, output)], dtype=object)


def mask_pairs(df: DataFrame, key: list[str], inputs: str, output: str) -> DataFrame:
    """key, text and target of the documents that are one chunk: the target has for each character of the chunk 1 if it is in the output, else 0.

    The output's separators go before it is compared, so of documents of several chunks none can be paired; they are left out.
    """
    single = df.where(F.size(inputs) == 1).select(*key, filled(F.get(F.col(inputs), F.lit(0))).alias("text"), without_separators(filled(F.col(output))).alias("__output"))
    return single.select(*key, "text", keep_mask_of("text", "__output").alias("target"))


def tokenised(df: DataFrame, text: str, encode: Callable[[list[str]], list[list[int]]], end: int, begin: int | None = None, name: str = "ids") -> DataFrame:
    """The rows with something in `text`, with `name` in its place: the tokenizer's ids without a leading begin token, and the end token behind them.

    encode takes the texts of an Arrow batch. Null and empty texts are skipped. Rows pass through Arrow as they are; nothing is shuffled.
    """
    rest = [c for c in df.columns if c != text]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[*(x[1:] if begin is not None and x and x[0] == begin else x), end] for x in encode(b.column(len(rest)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(made, pa.list_(pa.int32()))], [*rest, name])

    own = df.where(F.col(text) != "").select(*rest, text)
    return own.mapInArrow(run, f"{kinds}, `{name}` array<int>")


@F.pandas_udf(K.ArrayType(K.StructType([K.StructField("tag", K.StringType()), *(K.StructField(x, K.IntegerType()) for x in ("a1", "a2", "b1", "b2"))])))
def inline_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """The steps from one string to the other."""
    out = []
    for x, y in zip(a, b):
        steps = difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).get_opcodes()
        out.append([dict(zip(("tag", "a1", "a2", "b1", "b2"), s)) for s in steps])
    return pd.Series(out)


@F.pandas_udf(K.StringType())
def diff_html(before: pd.Series, after: pd.Series) -> pd.Series:
    """Both strings in one stretch of HTML: what went is marked as deleted, what came as inserted."""
    mark = lambda tag, kind, text: f'<{tag} class="diff-{kind}">{html.escape(text)}</{tag}>' if text else ""
    out = []
    for a, b in zip(before.fillna(""), after.fillna("")):
        steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        out.append("".join(html.escape(a[i:j]) if tag == "equal" else mark("del", "del", a[i:j]) + mark("ins", "ins", b[k:m]) for tag, i, j, k, m in steps))
    return pd.Series(out, dtype=object)


def masked_text(text: Column, mask: Column) -> Column:
    """The characters that the mask keeps."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(mask, ""), lambda c, m: F.when(m == "1", c).otherwise("")), "")


@F.pandas_udf(K.ArrayType(K.IntegerType()))
def token_labels(starts: pd.Series, ends: pd.Series, mask: pd.Series, length: pd.Series) -> pd.Series:
    """For each token from its start to its end: 0 if the mask has a 0 there, else 1; ignored where the span is empty or beyond. All 0 if the mask is not as
    long as the text. Zeros are summed along the mask once, so a long text costs as much as its length."""
    out = []
    for s, e, m, n in zip(starts, ends, mask, length):
        s, e, m = np.asarray(s, np.int64), np.asarray(e, np.int64), m or ""
        if len(m) != n:
            out.append(np.zeros(len(s), np.int32))
            continue
        zeros = np.concatenate(([0], np.cumsum(np.frombuffer(m.encode("ascii", "replace"), np.uint8) == 48)))
        bad = (e <= s) | (s < 0) | (e > n)
        held = zeros[np.clip(e, 0, n)] - zeros[np.clip(s, 0, n)]
        out.append(np.where(bad, IGNORED, np.where(held > 0, 0, 1)).astype(np.int32))
    return pd.Series(out)


@F.pandas_udf(K.StringType())
def kept_tokens(text: pd.Series, starts: pd.Series, ends: pd.Series, scores: pd.Series, threshold: pd.Series) -> pd.Series:
    """The text's stretches of the tokens with a score above the threshold."""
    out = []
    for t, s, e, p, least in zip(text, starts, ends, scores, threshold):
        keep = (np.asarray(p, float) > least) & (np.asarray(e) > np.asarray(s)) if len(s) else np.zeros(0, bool)
        out.append("".join([t[a:b] for a, b in zip(np.asarray(s)[keep].tolist(), np.asarray(e)[keep].tolist())]))
    return pd.Series(out, dtype=object)


def causal_example(prompt: Column, target: Column, most: int, full_loss: bool = False) -> tuple[Column, Column]:
    """Ids and labels of prompt and target: the prompt's labels are ignored, and what is over the limit goes from the left."""
    ids = F.concat(prompt, target)
    labels = ids if full_loss else F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), target)
    last = lambda x: F.when(F.size(x) > most, F.slice(x, -most, most)).otherwise(x)
    return last(ids), last(labels)


def padded(values: Column, size: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(size - F.size(values), F.lit(0)).cast("int")))
