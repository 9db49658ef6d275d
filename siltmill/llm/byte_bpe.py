"""Problem 7: encoding by a byte-level BPE vocabulary, exactly as its merges prescribe and in linear time.

Texts are divided into pre-tokens by array arithmetic. Each distinct pre-token is encoded once: its bytes become
Latin-1 characters, an Aho-Corasick automaton finds every vocabulary entry in it, and the encoder walks forward over
the longest matches, going back to a shorter one where two neighbours could not stand side by side after merging.
Whether two tokens can stand side by side is decided by undoing their merges and is remembered.

Results: null and empty texts give an empty list, never null. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import base64
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text_batch import LETTER, MARK, NUMBER, OTHER, SPACE, TextBlock, blocks, span_hashes

#: Distinct pre-tokens, and pairs of tokens, that a worker remembers before it forgets them all.
MEMORY = 300_000


def byte_characters() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable Latin-1 stands for itself, the rest for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return out


def merged_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Ids and merges of a JSON file, tokens as Latin-1 strings of their bytes."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    bytes_of = byte_characters()
    latin = lambda token: "".join(chr(bytes_of[c]) for c in token)
    ids = {latin(token): i for token, i in model["vocab"].items() if all(c in bytes_of for c in token)}
    return ids, [tuple(map(latin, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]


def ranked_vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """The same of a file of ranks: the merge that makes a token joins the two parts that the tokens of lower rank leave of it."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
    merges = []
    for token, own in sorted(ids.items(), key=lambda x: x[1]):
        parts = list(token)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ids.get(parts[i] + parts[i + 1], own))
            if ids.get(parts[best] + parts[best + 1], own) >= own:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return ids, merges


class ByteBPE:
    """A vocabulary with its merges. Works with ranks (bytes first, then merges in order) and gives ids."""

    def __init__(self, path: str):
        ids, merges = ranked_vocabulary(path) if path.endswith(".tiktoken") else merged_vocabulary(path)
        self.strings = [chr(b) for b in range(256)]
        self.ids = [ids[chr(b)] for b in range(256)]
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        rank = {chr(b): b for b in range(256)}
        for left, right in merges:
            a, b = rank[left], rank[right]
            token = self.strings[a] + self.strings[b]
            new = len(self.strings)
            self.pairs[a, b] = new
            if token not in rank:
                rank[token] = new
            self.strings.append(token)
            self.ids.append(ids[left + right])
            self.split.append((a, b))
        self.rank = rank
        self.sizes = [len(s) for s in self.strings]
        automaton = ahocorasick.Automaton()
        for token, r in rank.items():
            automaton.add_word(token, r)
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = [-1] * len(self.strings)
        for token, r in rank.items():
            for n in range(len(token) - 1, 0, -1):
                if (found := rank.get(token[:n])) is not None:
                    self.shorter[r] = found
                    break
        self.beside: dict[tuple[int, int], bool] = {}
        self.memory: dict[str, np.ndarray] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the tokens stay apart when the bytes of both are encoded together."""
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= MEMORY:
                self.beside.clear()
            known = self.beside[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo the later merge of the two first; a merge across the border that came before it would have happened.
        limit = len(self.strings)
        while True:
            if self.pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                if left < 256:
                    return True
                limit = left
                left = self.split[left][1]
                if left == limit:
                    return True
            else:
                if right < 256:
                    if left < 256:
                        return True
                    limit = left
                    left = self.split[left][1]
                else:
                    limit = right + 1
                    right = self.split[right][0]

    def encode_token(self, text: str) -> list[int]:
        """Ranks of one pre-token."""
        latin = text.encode("utf-8", "surrogatepass").decode("latin-1")
        if (whole := self.rank.get(latin)) is not None and self._is_own(whole):
            return [whole]
        longest = [0] * len(latin)
        for end, r in self.automaton.iter(latin):
            longest[end - self.sizes[r] + 1] = r  # later ends come later
        n, at, out, dead = len(latin), 0, [], bytearray(len(latin) + 1)
        token = longest[0]
        while True:
            end = at + self.sizes[token]
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.sizes[token]
                # The token that led nowhere is tried again, finds a dead end after it and becomes shorter.

    @functools.cache
    def _is_own(self, rank: int) -> bool:
        """Whether encoding the token's own bytes gives the token (true of every entry that merges can reach)."""
        a, b = self.split[rank]
        return rank < 256 or (self._is_own(a) and self._is_own(b) and self.fits_before(a, b, rank))

    def fits_before(self, left: int, right: int, rank: int) -> bool:
        """Whether the two stand side by side when only merges before the one that joins them are done."""
        taken = self.pairs.pop((left, right))
        try:
            return self._fits(left, right)
        finally:
            self.pairs[left, right] = taken

    def ids_of(self, text: str) -> np.ndarray:
        found = self.memory.get(text)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = np.array([self.ids[r] for r in self.encode_token(text)], np.int32)
            if len(text) <= 64:
                self.memory[text] = found
        return found


@functools.cache
def tokenizer(path: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path)


#: The endings that the pre-tokenizer's pattern divides off after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def pre_tokens(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pre-tokens of all texts, in order."""
    codes = block.codes
    kinds = np.where(block.kinds == MARK, OTHER, block.kinds)
    kinds[block.text_end] = 9
    start = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
    end = np.append(start[1:], len(kinds))
    kind = kinds[start]
    following = np.append(kind[1:], 9)
    # The last white space of a run goes with what follows if it is a blank, and stands alone otherwise.
    space = (kind == SPACE) & (following != 9)
    blank = space & (codes[end - 1] == 32)
    single = np.flatnonzero(space & ~blank & (end - start > 1))
    end = end - blank
    start = start - np.concatenate(([False], blank[:-1]))
    # 's and its like
    last = len(codes) - 1
    quote = np.flatnonzero((kind == OTHER) & (end - start == 1) & (codes[start] == 39) & (following == LETTER))
    if len(quote):
        at = start[quote]
        one, two = codes[np.minimum(at + 1, last)], codes[np.minimum(at + 2, last)]
        room = end[quote + 1] - start[quote + 1]
        size = np.zeros(len(quote), np.int64)
        for text in ENDINGS:
            hit = (one == ord(text[0])) & (room >= len(text)) & ((two == ord(text[1])) if len(text) == 2 else True)
            size = np.where((size == 0) & hit, len(text), size)
        end[quote] += size
        start[quote + 1] += size
    if len(single):
        start = np.concatenate((start, end[single] - 1))
        kind = np.concatenate((kind, kind[single]))
        end = np.concatenate((end, end[single]))
        end[single] -= 1
        order = np.argsort(start, kind="stable")
        start, end, kind = start[order], end[order], kind[order]
    keep = (end > start) & (kind != 9)
    return start[keep], end[keep]


def distinct(block: TextBlock, start: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pre-tokens as strings, and for each pre-token its place among them. Exact: equal hashes are compared."""
    hashes = span_hashes(block.codes, start, end)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    length = end - start
    same = first[inverse]
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(int(length.sum())) - np.repeat(begin, length)
    equal = length[same] == length
    if equal.all():
        equal = not np.any(block.codes[np.repeat(start, length) + within] != block.codes[np.repeat(start[same], length) + within])
    else:
        equal = False
    joined = "\n".join(block.texts) + "\n"
    if not equal:
        names: dict[str, int] = {}
        inverse = np.array([names.setdefault(joined[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
        return list(names), inverse
    return [joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], inverse


def encode_block(bpe: ByteBPE, block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the block, and the offsets of the texts in them."""
    start, end = pre_tokens(block)
    texts = len(block)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
    names, inverse = distinct(block, start, end)
    found = [bpe.ids_of(x) for x in names]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat, first = np.concatenate(found), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    size = sizes[inverse]
    out_end = np.cumsum(size)
    ids = flat[np.repeat(first[inverse] - (out_end - size), size) + np.arange(int(out_end[-1]))]
    tokens_before = np.searchsorted(start, block.text_end, side="left")
    offsets = np.concatenate(([0], np.concatenate(([0], out_end))[tokens_before]))
    return ids, offsets


def count_block(bpe: ByteBPE, block: TextBlock) -> np.ndarray:
    """Number of ids of each text."""
    return np.diff(encode_block(bpe, block)[1])


def encode_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key and ids array<int> of the text of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, part in blocks(texts):
                ids, offsets = encode_block(bpe, TextBlock(part))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(part)), lists], ["key", "ids"])

    schema = f"key {df.schema[key].dataType.simpleString()}, ids array<int>"
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key and tokens bigint of the text of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, part in blocks(texts):
                yield pa.RecordBatch.from_arrays([keys.slice(begin, len(part)), pa.array(count_block(bpe, TextBlock(part)), pa.int64())], ["key", "tokens"])

    schema = f"key {df.schema[key].dataType.simpleString()}, tokens bigint"
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
