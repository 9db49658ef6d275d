"""Problem 9: abusive, hateful and sexually explicit passages.

A convolutional text classifier in numpy: hashed word embeddings, filters of several widths over the whole text, the
maximum of each filter over the text, and a logistic layer. The maximum makes one passage enough, so labels of whole
documents suffice to learn passages. A first fit labels the documents that have no verdict, where it is sure; as
abusive documents mostly hold several passages, these teach the second fit passages that no labelled document has. Every
document with a verdict is fitted on or held out, and on those held out the thresholds are calibrated by language; every
document without one is judged by the first fit, and every document is scored over its whole text.

The documents to fit on are dealt to shards of at most SHARD or so by a hash. Each pass fits every shard in a task of its
own, from the same weights, which are then mixed (`mixing`): a word's by how many documents of the shard have it.

Disguised spellings are undone first: look-alike letters, digits and signs that stand for letters, marks inside words,
and letters set apart. Words that fewer than MIN_DOCUMENTS of the documents fitted on have count as one unknown word.

Results: null and blank texts have score 0 and are never cases. A missing language has a threshold of its own kind
("unknown"). Without labelled documents of both classes every score is 0. Several verdicts on a document are averaged;
a document whose verdicts disagree evenly is not used for the fit.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .mixing import PARTS, SCHEMA, joined, mixed, parts_of
from .text_batch import LETTER, NUMBER, TextBlock, blocks

#: Word buckets, embedding size, filter widths, filters of each width.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 24, (1, 2, 3, 5), 24
#: Scores as sure as which the first fit must be to label a document for the second. Those it labels as not abusive count as twice those it labels as abusive, at most.
SURE, SURE_NOT, NOT_TO_SURE = 0.85, 0.06, 2
#: Steps of the two fits on a shard (passes over it follow from them, within bounds), documents in a step, share held out for the thresholds.
FIRST_STEPS, STEPS, LEAST_PASSES, MOST_PASSES, STEP, HELD_OUT = 1_300, 2_000, 5, 40, 32, 0.2
#: Documents of a shard, at most or so: with them the least passes make up the steps.
SHARD = STEPS * STEP // LEAST_PASSES
#: Words that are scored at once: what they take should fit a core's cache.
SCORED_WORDS = 8_000
#: A word is known from this many documents on, whatever their number.
MIN_DOCUMENTS = 3
#: Fewest positive documents of a language for a threshold of its own.
LEAST_OWN = 12
PAD, UNKNOWN = 0, 1

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = str.maketrans("аеорсухкмнтвіјѕԁһԛԝαεορικντυχ", "aeopcyxkmhtbijsdhqwaeopikvtux")
#: Digits and signs written for letters.
SIGNS = str.maketrans("@$!3015+€|", "asieoisteI".lower())
#: Runs of letters are taken whole, and only from their first letter on, so a long token takes as many steps as it has characters.
_SIGNED = re.compile(r"(?<![^\W\d_])[^\W\d_]*+(?:[@$!3015+€|]+[^\W\d_]+)+|(?<![^\W\d_])[^\W\d_]++(?:[@$3015€|]+[^\W\d_]*)+")
_INSIDE = re.compile(r"(?<=[^\W\d_])[*_.\-·~](?=[^\W\d_])")
_MASKED = re.compile(r"([^\W\d_])[*#]{2,}([^\W\d_]*)")
_APART = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){2,}[^\W\d_](?!\w)")
_FOREIGN = re.compile("[\u00ad\u0370-\u052f\u200b-\u200f\u2060\ufeff\uff00-\uffef\U0001d400-\U0001d7ff]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SUSPECT = np.zeros(0x3000, bool)
_SUSPECT[[ord(c) for c in "@$!3015+€|*#_~·.-"]] = True
_SIGNS, _END_SIGNS = np.zeros(0x3000, bool), np.zeros(0x3000, bool)
_SIGNS[[ord(c) for c in "@$!3015+€|"]] = True
_END_SIGNS[[ord(c) for c in "@$3015€|"]] = True


def _plain_token(token: str, memory: dict[str, str]) -> str:
    found = memory.get(token)
    if found is None:
        found = token
        if "/" not in token and ("*" in token or sum(map(str.isalpha, token)) * 2 >= len(token)):
            found = _MASKED.sub(r"\1masked\2", token)
            found = _SIGNED.sub(lambda m: m.group().translate(SIGNS), found)
            found = _INSIDE.sub("", found)
        if len(memory) >= 100_000:
            memory.clear()
        memory[token] = found
    return found


def plain_spelling(text: str, memory: dict[str, str] | None = None) -> str:
    """The text in lower case with disguised spellings undone; white space is single blanks."""
    memory = {} if memory is None else memory
    text = text.lower()
    if _FOREIGN.search(text):
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text).lower()).translate(LOOK_ALIKE)
    text = _APART.sub(lambda m: re.sub(r"[ .\-_]", "", m.group()), text)
    return " ".join([t if t.isalpha() else _plain_token(t, memory) for t in text.split()])


def respelled(texts: list[str], memory: dict[str, str]) -> TextBlock:
    """The block of the texts in plain spelling. Only texts that show a sign of disguise are rewritten."""
    block = TextBlock(texts)
    codes, letters = block.codes, block.kinds == LETTER
    suspect = (codes < 0x3000) & _SUSPECT[np.minimum(codes, 0x2FFF)]
    suspect[1:-1] &= letters[:-2] & (letters[2:] | suspect[2:])
    suspect[1:-1] |= (codes[1:-1] < 0x3000) & _SUSPECT[np.minimum(codes[1:-1], 0x2FFF)] & letters[2:] & ~letters[:-2] & (codes[:-2] > 32)
    # all that _SIGNED can undo has one of its signs before a letter (1diot), or one of those it takes at the end behind one (as$)
    near, low = letters | ((block.kinds == NUMBER) & (codes > 57)), np.minimum(codes, 0x2FFF)
    suspect[:-1] |= _SIGNS[low[:-1]] & near[1:]
    suspect[1:] |= _END_SIGNS[low[1:]] & near[:-1]
    odd = (codes == 0xAD) | ((codes >= 0x370) & (codes < 0x530)) | ((codes >= 0x200B) & (codes <= 0x200F)) | (codes == 0x2060) | (codes == 0xFEFF) | ((codes >= 0xFF00) & (codes <= 0xFFEF)) | ((codes >= 0x1D400) & (codes < 0x1D800))
    flagged = np.zeros(len(texts) + 1, bool)
    flagged[np.searchsorted(block.text_end, np.flatnonzero(suspect | odd))] = True
    single = (block.word_end - block.word_start == 1) & letters[block.word_start] if len(block.word_start) else np.zeros(0, bool)
    if len(single) > 2:
        near = np.diff(block.word_start) == 2
        runs = np.flatnonzero(single[:-2] & single[1:-1] & single[2:] & near[:-1] & near[1:])
        flagged[block.word_text[runs]] = True
    which = np.flatnonzero(flagged[: len(texts)])
    if not len(which):
        return block
    texts = list(texts)
    for i in which:
        texts[i] = plain_spelling(texts[i], memory)
    return TextBlock(texts)


def word_buckets(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the first word of each text (one more entry closes the last)."""
    first = np.searchsorted(block.word_text, np.arange(len(block) + 1))
    return (block.word_hash >> np.uint64(49)).astype(np.int64) + 2, first


def convolved(vectors: np.ndarray, filters: list[np.ndarray], ids: np.ndarray, n: int) -> list[np.ndarray]:
    """For each width the value of every filter on the windows that begin at the first n words. Words are given by their place among the vectors, each of which is multiplied once."""
    out, part = [], np.empty((n, FILTERS), np.float32)
    for width, weights in zip(WIDTHS, filters):
        total = (vectors @ weights[:SIZE]).take(ids[:n], axis=0)
        for j in range(1, width):
            total += np.take(vectors @ weights[j * SIZE : (j + 1) * SIZE], ids[j : j + n], axis=0, out=part, mode="clip")
        out.append(total)
    return out


class Places:
    """The distinct ones of some buckets in order, and the place of each among them."""

    def __init__(self):
        self.has, self.place = np.zeros(BUCKETS + 2, bool), np.zeros(BUCKETS + 2, np.int64)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.has[ids] = True
        used = np.flatnonzero(self.has)
        self.has[used] = False
        self.place[used] = np.arange(len(used))
        return used, self.place[ids]


@dataclass
class AbuseModel:
    known: np.ndarray
    words: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each text. Words are projected once for each distinct one."""
        counts = np.diff(first)
        pad = max(WIDTHS) - 1
        # each text is followed by pads
        starts = first[:-1] + pad * np.arange(len(counts))
        laid = np.full(int(first[-1]) + pad * len(counts) + pad, PAD, np.int64)
        laid[np.arange(len(buckets)) + pad * np.repeat(np.arange(len(counts)), counts)] = np.where(self.known[buckets], buckets, UNKNOWN)
        used, ids = Places().of(laid)
        out = np.zeros((len(counts), FILTERS * len(WIDTHS)), np.float32)
        filled = counts > 0
        # windows begin at the text's own words; they may reach into its pads, never into the next text
        spans = list(zip(np.flatnonzero(filled).tolist(), starts[filled].tolist(), (starts + counts)[filled].tolist()))
        for k, total in enumerate(convolved(self.words[used], self.filters, ids, len(laid) - pad)):
            for i, a, b in spans:
                np.maximum.reduce(total[a:b], axis=0, out=out[i, k * FILTERS : (k + 1) * FILTERS])
        out[filled] = np.maximum(out[filled] + np.concatenate(self.biases), 0)
        return out

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        score = 1 / (1 + np.exp(-np.clip(self.pooled(buckets, first) @ self.out + self.out_bias, -30, 30)))
        return np.where(np.diff(first) > 0, score, 0.0)

    def threshold(self, language: str | None) -> float:
        return self.thresholds.get(language or "unknown", self.thresholds[""])


@dataclass
class Training:
    """A model while it is fitted: dense holds the filters, biases and output weights, with their means and squares of gradients."""

    words: np.ndarray
    word_square: np.ndarray
    dense: np.ndarray
    steps: int = 0

    @classmethod
    def start(cls, seed: int) -> Training:
        rng = np.random.default_rng(seed)
        words = rng.normal(0, 0.3, (BUCKETS + 2, SIZE)).astype(np.float32)
        words[PAD] = 0
        filters = [rng.normal(0, (2 / (w * SIZE)) ** 0.5, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        out = rng.normal(0, 0.1, FILTERS * len(WIDTHS))
        weights = np.concatenate([*(f.ravel() for f in filters), np.zeros(FILTERS * len(WIDTHS)), out, np.zeros(1)]).astype(np.float32)
        return cls(words, np.full(BUCKETS + 2, 1e-9, np.float32), np.concatenate((weights, np.zeros(2 * len(weights), np.float32))))

    def arrays(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """Filters, biases, output weights and output bias, as views of dense."""
        n, at = FILTERS * len(WIDTHS), 0
        filters = []
        for w in WIDTHS:
            filters.append(self.dense[at : at + w * SIZE * FILTERS].reshape(w * SIZE, FILTERS))
            at += w * SIZE * FILTERS
        biases = [self.dense[at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(len(WIDTHS))]
        return filters, biases, self.dense[at + n : at + 2 * n], self.dense[at + 2 * n : at + 2 * n + 1]

    def model(self, known: np.ndarray) -> AbuseModel:
        filters, biases, out, out_bias = self.arrays()
        return AbuseModel(known, self.words, filters, biases, out, float(out_bias[0]))

    def descend(self, gradients: list[np.ndarray], rate: float) -> None:
        """A step of Adam on dense."""
        self.steps += 1
        a, m, s = self.dense.reshape(3, -1)
        g = np.concatenate([x.ravel() for x in gradients])
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        a -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float, rng: np.random.Generator) -> None:
        """One pass over documents given as arrays of the buckets of known words."""
        words, (filters, biases, out, out_bias) = self.words, self.arrays()
        pad, columns, places = max(WIDTHS) - 1, np.arange(FILTERS), Places()
        order = rng.permutation(len(rows))
        pads = np.full(pad, PAD)
        for i in range(0, len(order), STEP):
            part = order[i : i + STEP]
            laid = np.concatenate([x for d in part for x in (rows[d], pads)] + [pads])
            ends = np.cumsum([len(rows[d]) + pad for d in part])
            begins = np.concatenate(([0], ends[:-1]))
            used, ids = places.of(laid)
            at, tops = np.empty((len(part), FILTERS * len(WIDTHS)), np.int64), []
            spans = list(zip(begins.tolist(), (ends - pad).tolist()))
            for k, total in enumerate(convolved(words[used], filters, ids, int(ends[-1]))):
                mine = at[:, k * FILTERS : (k + 1) * FILTERS]
                for row, (a, b) in zip(mine, spans):
                    total[a:b].argmax(0, out=row)
                mine += begins[:, None]
                tops.append(total[mine, columns] + biases[k])
            raw = np.concatenate(tops, 1)
            keep = (rng.random(raw.shape) > 0.3) / np.float32(0.7)
            active = np.maximum(raw, 0) * keep
            score = 1 / (1 + np.exp(-np.clip(active @ out + out_bias[0], -30, 30)))
            error = ((score - (labels[part] * 0.96 + 0.02)) * weight[part] / len(part)).astype(np.float32)
            d_out = active.T @ error + 1e-4 * out
            g = (error[:, None] * out[None, :] * keep * (raw > 0)).astype(np.float32)
            # the gradients of the filters' values on each distinct word that one of the windows has
            document, column = np.nonzero(g)
            first, moved = at[document, column], g[document, column]
            of = [np.flatnonzero(column // FILTERS == k) for k in range(len(WIDTHS))]
            touched, near = places.of(np.concatenate([laid[first[x] + j] for x, width in zip(of, WIDTHS) for j in range(width)]))
            vectors, by_place = words[touched], [f.reshape(-1, SIZE, FILTERS).transpose(0, 2, 1).reshape(-1, SIZE) for f in filters]
            cells = np.concatenate([column[x] % FILTERS + (sum(WIDTHS[:k]) + j) * FILTERS for k, x in enumerate(of) for j in range(WIDTHS[k])])
            on = np.zeros((len(touched), sum(WIDTHS) * FILTERS), np.float32)
            np.add.at(on.reshape(-1), near * on.shape[1] + cells, np.concatenate([moved[x] for x, width in zip(of, WIDTHS) for _ in range(width)]))
            d_words = on @ np.concatenate(by_place)
            d = (vectors.T @ on).reshape(SIZE, -1, FILTERS).transpose(1, 0, 2)
            d_filters = np.split(d, np.cumsum(WIDTHS)[:-1])
            self.descend([*d_filters, g.sum(0), d_out, np.array([error.sum()], np.float32)], rate)
            self.word_square[touched] += (d_words * d_words).mean(1)
            words[touched] -= 5 * rate * d_words / np.sqrt(self.word_square[touched])[:, None]
            words[PAD] = 0


def seen_in(rows: list[np.ndarray]) -> np.ndarray:
    """In how many of the documents each bucket is."""
    seen, last = np.zeros(BUCKETS + 2, np.int64), np.zeros(BUCKETS + 2, np.int64)
    for r in rows:
        # of each bucket one place, whichever was written last
        places = np.arange(len(r))
        last[r] = places
        seen[r[last[r] == places]] += 1
    return seen


def positive_weight(documents: float, positive: float) -> float:
    """What a positive document counts as among so many."""
    return min(3.0, (documents / max(positive, 1) / 2) ** 0.5)


def passes_over(documents: float, steps: int) -> int:
    return int(np.clip(steps * STEP / max(documents, 1), LEAST_PASSES, MOST_PASSES))


def rate_of(turn: int, passes: int) -> float:
    return 0.01 * (1 - 0.9 * turn / passes)


def fit_network(rows: list[np.ndarray], labels: np.ndarray, seed: int = 5, steps: int = STEPS) -> AbuseModel:
    """Fits on documents given as arrays of word buckets, as one shard and without a session."""
    filled = [i for i, r in enumerate(rows) if len(r)]
    rows, labels = [rows[i] for i in filled], labels[filled]
    known = seen_in(rows) >= MIN_DOCUMENTS
    rows = [np.where(known[r], r, UNKNOWN) for r in rows]
    weight = np.where(labels > 0.5, positive_weight(len(rows), labels.sum()), 1.0)
    training, rng, passes = Training.start(seed), np.random.default_rng((seed, 0)), passes_over(len(rows), steps)
    for turn in range(passes):
        training.fit(rows, labels, weight, rate_of(turn, passes), rng)
    return training.model(known)


def fit_shards(shards: DataFrame, of: int, weights: dict[tuple[int, bool], float], documents: int, seed: int, steps: int) -> AbuseModel:
    """The model of documents (shard, number, y, own, words) that lie by shard, which are `of`. weights: what a document counts as, by y and whether its verdict is its own."""
    spark = shards.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 2, np.int64)
        for batch in batches:
            seen += seen_in([np.frombuffer(w, np.uint16) for w in batch.column(0).to_pylist()])
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(seen[found], pa.int64())], ["bucket", "n"])

    counted = shards.select("words").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCUMENTS).toArrow()
    known = np.zeros(BUCKETS + 2, bool)
    known[counted.column(0).to_numpy()] = True
    passes = passes_over(documents / of, steps)
    training = Training.start(seed)
    # a single shard needs no mixing between its passes
    for turns in [range(passes)] if of == 1 else [[t] for t in range(passes)]:
        sent = spark.sparkContext.broadcast((training, known))

        def run(batches: Iterator[pa.RecordBatch], turns=turns, sent=sent) -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list] = {}
            for batch in batches:
                for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    dealt.setdefault(shard, []).append(row)
            for shard, mine in sorted(dealt.items()):
                mine.sort(key=lambda r: (r[0], r[3]))
                start, known = sent.value
                fitted = Training(start.words.copy(), start.word_square.copy(), start.dense.copy(), start.steps)
                meant = np.where(known, np.arange(len(known)), UNKNOWN)
                rows = [meant[np.frombuffer(r[3], np.uint16)] for r in mine]
                labels, weight = np.array([r[1] for r in mine], float), np.array([weights[r[1], r[2]] for r in mine])
                for turn in turns:
                    fitted.fit(rows, labels, weight, rate_of(turn, passes), np.random.default_rng((seed, shard, turn)))
                seen = seen_in(rows)
                parts = [*parts_of(shard, fitted.dense, np.full(len(fitted.dense), len(rows))), *parts_of(shard, fitted.words, seen, PARTS), *parts_of(shard, fitted.word_square, seen, 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*parts), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "shard", "value", "seen"])

        found = mixed(shards.select("shard", "number", "y", "own", "words").mapInArrow(run, SCHEMA))
        steps_done = training.steps + len(turns) * math.ceil(documents / of / STEP)
        training = Training(joined(found, PARTS).reshape(-1, SIZE).copy(), joined(found, 2 * PARTS).copy(), joined(found).copy(), steps_done)
        sent.unpersist()
    return training.model(known)


def best_threshold(scores: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> float:
    """The threshold with the best F1; times says how often each score stands there."""
    order = np.argsort(-scores, kind="stable")
    scores, labels, times = scores[order], labels[order], np.ones(len(scores)) if times is None else times[order]
    hits, false = np.cumsum(labels * times), np.cumsum((1 - labels) * times)
    f1 = 2 * hits / np.maximum(hits + false + hits[-1], 1e-9)
    # a threshold lies between two scores
    f1[:-1][scores[:-1] == scores[1:]] = -1
    best = int(f1.argmax())
    after = scores[best + 1] if best + 1 < len(scores) else 0.0
    return float(np.clip((scores[best] + after) / 2, 0.35, 0.85))


def word_rows(documents: DataFrame, key: str, text: str, language: str, source: str) -> DataFrame:
    """key, language, source, number (a hash of the key and text) and words of every document: the buckets of its words in plain spelling, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        for batch in batches:
            for begin, part in blocks(batch.column(4).to_pylist(), 400_000):
                buckets, first = word_buckets(respelled(part, memory))
                buckets = buckets.astype(np.uint16)
                words = [buckets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, len(part)) for i in range(4)), pa.array(words, pa.binary())], ["key", "language", "source", "number", "words"])

    number = F.xxhash64(documents[key], documents[text])
    chosen = documents.select(documents[key].alias("key"), documents[language].alias("language"), documents[source].alias("source"), number.alias("number"), documents[text].alias("text"))
    kinds = [f"{n} {documents.schema[c].dataType.simpleString()}" for n, c in zip(("key", "language", "source"), (key, language, source))]
    return chosen.mapInArrow(run, f"{', '.join(kinds)}, number bigint, words binary")


def scores_of(words: list[bytes], model: AbuseModel) -> np.ndarray:
    """The score of each document, whose words are as word_rows gives them."""
    out, begin, size = [np.zeros(0)], 0, 0
    for i, w in enumerate(words):
        size += len(w) // 2
        if size >= SCORED_WORDS or i == len(words) - 1:
            part = words[begin : i + 1]
            out.append(model.scores(np.frombuffer(b"".join(part), np.uint16).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) // 2 for x in part])))))
            begin, size = i + 1, 0
    return np.concatenate(out)


def fit_abuse(rows: DataFrame, seed: int = 5) -> AbuseModel | None:
    """Model and thresholds of all documents: word_rows with y (the verdict, or null)."""
    spark = rows.sparkSession
    filled = rows.where("length(words) > 0")
    held = F.pmod(F.shiftrightunsigned("number", 40), F.lit(1000)) < int(HELD_OUT * 1000)
    counts = {(r["y"], r["held"]): r["count"] for r in filled.groupBy("y", held.alias("held")).count().collect()}
    size = lambda y, *parts: sum(counts.get((y, h), 0) for h in parts)
    if min(size(1, True, False), size(0, True, False)) < 2:
        return None
    hold_out = size(1, True) >= 3 and size(1, False) > 0 and size(0, False) > 0
    parts = (False,) if hold_out else (True, False)
    own = F.col("y").isNotNull() & ~held if hold_out else F.col("y").isNotNull()

    def dealt(df: DataFrame, of: int) -> DataFrame:
        placed = df.withColumn("shard", F.pmod(F.shiftrightunsigned("number", 20), F.lit(of)).cast("int"))
        return durable(placed.select("shard", "number", "y", "own", "words").repartitionById(of, "shard"))

    positive, negative = size(1, *parts), size(0, *parts)
    of = math.ceil((positive + negative) / SHARD)
    first = fit_shards(dealt(filled.where(own).withColumn("own", F.lit(True)), of), of, {(1, True): positive_weight(positive + negative, positive), (0, True): 1.0}, positive + negative, seed, FIRST_STEPS)
    sent = spark.sparkContext.broadcast(first)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()], np.int32)
            score = np.full(len(y), 0.5)
            score[y < 0] = scores_of([w for w, x in zip(batch.column(2).to_pylist(), y) if x < 0], sent.value)
            made = np.where(y >= 0, y, np.where(score >= SURE, 1, np.where(score <= SURE_NOT, 0, -1)))
            kept = pa.array(np.flatnonzero(made >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), pa.array(made[made >= 0], pa.int32()), pa.array(y[made >= 0] >= 0), batch.column(2).take(kept)], ["number", "y", "own", "words"])

    given = filled.where(own | F.col("y").isNull()).select("number", "y", "words")
    of = math.ceil((positive + negative + size(None, True, False)) / SHARD)
    second = dealt(given.mapInArrow(label, "number bigint, y int, own boolean, words binary"), of)
    made = {(r["y"], r["own"]): r["count"] for r in second.groupBy("y", "own").count().collect()}
    sure, sure_not = made.get((1, False), 0), made.get((0, False), 0)
    share = min(1.0, NOT_TO_SURE * sure / max(sure_not, 1))
    weight = positive_weight(positive + negative + sure + sure_not * share, positive + sure)
    model = fit_shards(second, of, {(1, True): weight, (1, False): weight, (0, True): 1.0, (0, False): share}, sum(made.values()), seed + 1, STEPS)
    model.thresholds[""] = 0.5
    if not hold_out:
        return model
    sent = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(scores_of(batch.column(2).to_pylist(), sent.value), 4))], ["language", "y", "score"])

    tongue = F.when(F.coalesce(F.col("language").cast("string"), F.lit("")) == "", "unknown").otherwise(F.col("language").cast("string"))
    judged = filled.where(F.col("y").isNotNull() & held).select(tongue.alias("language"), "y", "words").mapInArrow(judge, "language string, y int, score double")
    found = judged.groupBy("language", "y", "score").count().toArrow().sort_by([("language", "ascending"), ("score", "descending"), ("y", "ascending")])
    tongues, y, scores, times = (np.array(c.to_pylist()) for c in found.columns)
    model.thresholds[""] = best_threshold(scores, y, times)
    for name in sorted(set(tongues)):
        mine = tongues == name
        if (y[mine] * times[mine]).sum() >= LEAST_OWN:
            model.thresholds[str(name)] = best_threshold(scores[mine], y[mine], times[mine])
    return model


def judged_rows(documents: DataFrame, labels: DataFrame, key: str, text: str, language: str, source: str, label: str) -> DataFrame:
    """word_rows of every document with y: 1 or 0 by its verdicts, null where there is none or they disagree evenly. Texts are not shuffled; their words are, once."""
    verdicts = labels.groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("y")).where("y IS NOT NULL AND y <> 0.5").select("key", (F.col("y") > 0.5).cast("int").alias("y"))
    parts = max(documents.rdd.getNumPartitions(), documents.sparkSession.sparkContext.defaultParallelism)
    return durable(word_rows(documents, key, text, language, source).repartition(parts, "key").join(verdicts, "key", "left"))


def score_abuse(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", label: str = "toxic") -> DataFrame:
    """key, source, abuse_score and is_abusive of every document. The model (3 MB) goes to the workers; texts are read once and not shuffled."""
    rows = judged_rows(documents, labels, key, text, language, source, label)
    model = documents.sparkSession.sparkContext.broadcast(fit_abuse(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            tongues, words = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if fitted is None:
                score, cut = np.zeros(len(words)), np.ones(len(words))
            else:
                score, cut = scores_of(words, fitted), np.array([fitted.threshold(x) for x in tongues])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(score >= cut)], ["key", "source", "abuse_score", "is_abusive"])

    kinds = f"key {documents.schema[key].dataType.simpleString()}, source {documents.schema[source].dataType.simpleString()}, abuse_score double, is_abusive boolean"
    return rows.select("key", "source", "language", "words").mapInArrow(run, kinds).withColumnRenamed("key", key).withColumnRenamed("source", source)


def abuse_rate(scored: DataFrame, source: str = "source") -> DataFrame:
    """By source: documents, abusive ones, their share and the mean score."""
    hits = F.count_if("is_abusive")
    return scored.groupBy(source).agg(F.count("*").alias("documents"), hits.alias("abusive"), (hits / F.count("*")).alias("abusive_share"), F.avg("abuse_score").alias("mean_score"))
