"""Column-at-a-time text analysis for Arrow batches.

Every operator of this subpackage that has to look at characters does so on a whole block of texts at once: the
texts are laid end to end in one array of code points, each followed by a line feed, and lines, words and hashes
are found with array arithmetic. A block holds about a million characters however long or short its texts are, so
a worker's memory does not depend on the batch size or on the longest text (a single text is never divided).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

#: Characters in one block. One longer text makes a block of its own.
BLOCK_CHARS = 1_000_000
#: Code points from here on are private, unassigned or format characters; all count as OTHER.
_TABLE = 0x33480

LETTER, NUMBER, SPACE, OTHER, MARK = 0, 1, 2, 3, 4
#: The Unicode white space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def char_kinds() -> np.ndarray:
    """Kind of every code point below the table's size."""
    kinds = np.full(_TABLE + 1, OTHER, np.uint8)
    by_major = {"L": LETTER, "N": NUMBER, "M": MARK}
    for code in range(_TABLE):
        kinds[code] = by_major.get(unicodedata.category(chr(code))[0], OTHER)
    kinds[[ord(c) for c in WHITE_SPACE]] = SPACE
    return kinds


@functools.cache
def lower_codes() -> np.ndarray:
    """Lower case of every code point below the table's size, where it is one code point."""
    low = np.arange(_TABLE + 1, dtype=np.uint32)
    for code in range(_TABLE):
        if len(x := chr(code).lower()) == 1:
            low[code] = ord(x)
    return low


@functools.cache
def _code_keys() -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)


@functools.cache
def _powers() -> np.ndarray:
    out, base = np.ones(1 << 12, np.uint64), 0x9E3779B97F4A7C15
    for i in range(1, len(out)):
        out[i] = np.uint64(int(out[i - 1]) * base % 2**64)
    return out


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end) of the code points; equal spans have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    chars = codes[np.repeat(starts, lengths) + within]
    powers = _powers()
    parts = _code_keys()[chars & 0xFFFF] + (chars >> 16).astype(np.uint64)
    parts *= powers[within & (len(powers) - 1)]
    out = np.add.reduceat(parts, first)
    out ^= lengths.astype(np.uint64) * powers[7]
    out ^= out >> np.uint64(29)
    return out * powers[1]


def word_hash(word: str) -> int:
    """Hash that TextBlock gives to this word (in lower case)."""
    codes = lower_codes()[np.minimum(np.array([ord(c) for c in word], np.uint32), _TABLE)]
    return int(span_hashes(codes, np.array([0]), np.array([len(codes)]))[0])


def word_hashes(words: Sequence[str]) -> np.ndarray:
    """Sorted hashes of a word list."""
    return np.unique(np.array([word_hash(w) for w in words], np.uint64))


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Membership of each value in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def blocks(texts: Sequence[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of the texts of about `limit` characters, each with the position of its first; null is ""."""
    begin, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield begin, run
            begin, size, run = i, 0, []
        run.append(text)
        size += len(text) + 1
    if run:
        yield begin, run


class TextBlock:
    """Some texts as arrays. Text t is codes[text_start[t]:text_end[t]]; at text_end[t] stands a line feed."""

    def __init__(self, texts: Sequence[str]):
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        self.clipped = np.minimum(self.codes, _TABLE)
        self.kinds = char_kinds()[self.clipped]

    def __len__(self) -> int:
        return len(self.texts)

    @functools.cached_property
    def low(self) -> np.ndarray:
        return lower_codes()[self.clipped]

    @functools.cached_property
    def line_end(self) -> np.ndarray:
        return np.flatnonzero(self.codes == 10)

    @functools.cached_property
    def line_start(self) -> np.ndarray:
        return np.concatenate(([0], self.line_end[:-1] + 1))

    @functools.cached_property
    def line_text(self) -> np.ndarray:
        """Text of each line."""
        return np.searchsorted(self.text_end, self.line_end)

    @functools.cached_property
    def first_line(self) -> np.ndarray:
        """First line of each text; one more entry closes the last text."""
        return np.searchsorted(self.line_text, np.arange(len(self) + 1))

    @functools.cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        inside = (self.kinds == LETTER) | (self.kinds == NUMBER) | (self.kinds == MARK)
        step = np.diff(inside.astype(np.int8), prepend=0)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    @property
    def word_start(self) -> np.ndarray:
        """Words are runs of letters, digits and marks; the line feed after each text ends its last one."""
        return self._words[0]

    @property
    def word_end(self) -> np.ndarray:
        return self._words[1]

    @functools.cached_property
    def word_hash(self) -> np.ndarray:
        """Hash of each word in lower case."""
        return span_hashes(self.low, self.word_start, self.word_end)

    @functools.cached_property
    def word_text(self) -> np.ndarray:
        return np.searchsorted(self.text_end, self.word_start)

    @functools.cached_property
    def word_line(self) -> np.ndarray:
        return np.searchsorted(self.line_end, self.word_start)

    def per_line(self, chosen: np.ndarray) -> np.ndarray:
        """Number of chosen characters in each line."""
        total = np.concatenate(([0], np.cumsum(chosen, dtype=np.int64)))
        return total[self.line_end] - total[self.line_start]

    def words_per_line(self, chosen: np.ndarray | None = None) -> np.ndarray:
        line = self.word_line if chosen is None else self.word_line[chosen]
        return np.bincount(line, minlength=len(self.line_end))

    def sum_lines(self, values: np.ndarray) -> np.ndarray:
        """Sum over the lines of each text."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
        return total[self.first_line[1:]] - total[self.first_line[:-1]]
