"""Problem 4: evaluation items inside texts.

Every window of a few words, of the texts and of the items, is embedded by a random walk (CGK): the walk reads the
window word by word and at each step either stays on the word or goes on, as a hash of step and word says. Windows at a
small edit distance get strings at a small Hamming distance, so a key made of a few sampled positions of the string is
equal for most of them; several walks with other samples raise the share. Two of the samples are of the walk's first half
alone, one of them of a walk from the window's end backwards: a single edit leaves one of these as it was, so short
windows with an edit are found too. Item windows are kept by key, text windows look their keys up, and each candidate
(text, item, diagonal) is verified exactly on the words, over edits by an alignment.

Words are runs of letters and digits in lower case; entities are decoded and tags removed first, those of blocks and
breaks for a blank. Sentences that stand in the queries of several different items are wording and do not count. Items
are a bounded table (at most MOST_ITEMS, checked), taken in blocks of `MAX_ITEMS` or `MAX_WORDS` against all texts; they
and their keys go to the workers.

Results: null and blank texts hold nothing. Items with equal texts are found each. A query without own words, and
choices of fewer than eight words, cannot leak. A text that holds an item several times gives one row.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text_batch import TextBlock, blocks

#: Sequences of one block, and most words in all of them; most items of a call.
MAX_ITEMS, MAX_WORDS, MOST_ITEMS = 20_000, 2_000_000, 1_000_000
#: Words of a window; shorter for items of which half is less.
WINDOW = 8
#: Walks sampled over their whole length, positions sampled of each, and the steps they are sampled from.
WALKS, SAMPLED, STEPS = 3, 8, 14
#: Fewest words of a passage one of which may differ.
EDITED = 7
#: Passages of fewer words have too few windows to miss any.
SHORT = 10
#: Diagonals no farther from the next than this belong to one passage.
NEAR = 12
#: A sentence in the queries of more items than this (repeated items count once) is wording.
SHARED_BY = 3
#: Least words of a choice that counts.
CHOICE_WORDS = 8
#: Least share of a query's words in one passage.
QUERY_SHARE = 0.5

_TAG = re.compile(r"</?([A-Za-z][\w:-]*)(?:[\s/][^<>]*)?>")
#: Tags that stand inside words and lines; the others end a word.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var".split())
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_WORD = re.compile(r"[^\W_]+")


def without_markup(text: str) -> str:
    """The text without tags, entities and the marks of light markup inside words."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[1].lower() in INLINE else " ", text)
    if "&" in text:
        text = html.unescape(text)
    return text


def item_words(text: str) -> list[str]:
    return _WORD.findall(without_markup(text).lower())


@dataclass
class Sequence_:
    """A run of words that must be found: a query's own words, or one choice."""

    item: str
    is_query: bool
    words: list[str]

    @property
    def least(self) -> int:
        return -(-len(self.words) // 2) if self.is_query else len(self.words)


def item_sequences(items: list[tuple[str, str | None, list[str] | None]]) -> list[Sequence_]:
    """What is looked for of each (id, query, choices)."""
    items_with: dict[tuple[str, ...], set[tuple]] = defaultdict(set)
    split = []
    for _, query, choices in items:
        sentences = [tuple(item_words(s)) for s in _SENTENCE.split((query or "").strip())]
        split.append(sentences)
        whole = (tuple(w for s in sentences for w in s), tuple(tuple(item_words(c or "")) for c in choices or []))
        for s in sentences:
            items_with[s].add(whole)
    out = []
    for (item, _, choices), sentences in zip(items, split):
        own = [w for s in sentences if len(items_with[s]) <= SHARED_BY for w in s]
        if own:
            out.append(Sequence_(item, True, own))
        out += [Sequence_(item, False, words) for c in choices or [] if len(words := item_words(c or "")) >= CHOICE_WORDS]
    return out


def _mixed(hashes: np.ndarray, walk: int) -> np.ndarray:
    """Bits of the walk: bit j of a word says whether step j goes on to the next word."""
    x = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (2 * walk + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(40)).astype(np.uint32)


def samples(size: int, short: bool) -> list[tuple[int, bool, list[int]]]:
    """walk, direction and steps sampled of each key of windows of this size; short: for passages with hardly more words than the window."""
    # A window never ends within the walk if it has as many words as half the steps; otherwise the end is a word of its own.
    steps = min(STEPS, 2 * size)
    if size < EDITED:
        return [(0, False, list(range(steps)))]  # too short for an edit, so all of the walk must be equal
    whole = [(w, False, sorted(np.random.default_rng(100 + w).permutation(steps)[:SAMPLED].tolist())) for w in range(WALKS)]
    # so many steps read about half the window, or more of it
    half = list(range(size - 1 if short else size + 2))
    return [*whole, (WALKS, False, half), (WALKS + 1, True, half)]


def window_keys(hashes: np.ndarray, starts: np.ndarray, size: int, walk: int, backward: bool, sampled: list[int]) -> np.ndarray:
    """Key of the window of `size` words from each start: the sampled positions of its embedding."""
    bits = _mixed(hashes, walk)
    first = starts.astype(np.int32)
    at, gone = (first + np.int32(size - 1), np.int32(-1)) if backward else (first, np.int32(1))
    low, high = first - np.int32(1), first + np.int32(size)
    key = np.full(len(at), 0x51ED270B * (size + 1), np.uint64)
    wanted = set(sampled)
    for step in range(max(sampled) + 1):
        inside = (at > low) & (at < high)
        here = np.clip(at, 0, len(hashes) - 1)
        if step in wanted:
            key ^= np.where(inside, hashes[here], np.uint64(1))
            key *= np.uint64(0x9DDFEA08EB382D69)
            key ^= key >> np.uint64(31)
        on = ((bits[here] >> np.uint32(step)) & np.uint32(1)).astype(np.int32)
        at = np.where(inside, at + gone * on, at)
    return key


class ItemIndex:
    """Keys of all item windows, and the words for verification."""

    def __init__(self, sequences: list[Sequence_]):
        self.sequences = sequences
        block = TextBlock([" ".join(s.words) for s in sequences] or [""])
        first = np.searchsorted(block.word_text, np.arange(len(sequences) + 1))
        self.words = [block.word_hash[first[i] : first[i + 1]] for i in range(len(sequences))]
        by_size: dict[tuple[int, bool], list[tuple[int, int]]] = defaultdict(list)
        for i, s in enumerate(sequences):
            size = min(WINDOW, s.least)
            by_size[size, s.least < SHORT] += [(i, j) for j in range(len(self.words[i]) - size + 1)]
        self.sizes = {}
        for (size, short), windows in by_size.items():
            where = np.array(windows, np.int64)
            starts = first[where[:, 0]] + where[:, 1]
            tables = []
            for sample in samples(size, short):
                keys = window_keys(block.word_hash, starts, size, *sample)
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << 22, bool)
                seen[keys >> np.uint64(42)] = True
                tables.append((keys[order], where[order], seen))
            self.sizes[size, short] = tables

    def candidates(self, block: TextBlock) -> np.ndarray:
        """Rows (text, sequence, place of the sequence's first word among the block's words) with an equal key."""
        hashes, of = block.word_hash, block.word_text
        out = [np.zeros((0, 3), np.int64)]
        for (size, short), tables in self.sizes.items():
            n = len(hashes) - size + 1
            if n <= 0:
                continue
            starts = np.flatnonzero(of[:n] == of[size - 1 :])
            for sample, (keys, where, seen) in zip(samples(size, short), tables):
                own = window_keys(hashes, starts, size, *sample)
                maybe = np.flatnonzero(seen[own >> np.uint64(42)])
                low = np.searchsorted(keys, own[maybe], side="left")
                count = np.searchsorted(keys, own[maybe], side="right") - low
                hit = np.flatnonzero(count)
                if not len(hit):
                    continue
                count, low, begin = count[hit], low[hit], starts[maybe[hit]]
                index = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                begin = np.repeat(begin, count)
                out.append(np.stack([of[begin], where[index, 0], begin - where[index, 1]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def verified(self, block: TextBlock) -> set[tuple[int, str]]:
        """(text, item) that hold: exact comparison of the words along the diagonals of the candidates."""
        found: set[tuple[int, str]] = set()
        hashes = block.word_hash
        first = np.searchsorted(block.word_text, np.arange(len(block) + 1))
        rows = self.candidates(block).tolist()
        tried: dict[tuple[int, int], list[int]] = defaultdict(list)
        for text, s, place in rows:
            tried[text, s].append(place)
        for (text, s), places in tried.items():
            sequence = self.sequences[s]
            if (text, sequence.item) in found:
                continue
            low, high = int(first[text]), int(first[text + 1])
            words = self.words[s]
            n, least = len(words), sequence.least
            best, runs = 0, []
            for place in places:
                a, b = max(0, low - place), min(n, high - place)
                equal = words[a:b] == hashes[place + a : place + b]
                if not sequence.is_query:
                    best = n if len(equal) == n and equal.all() else best
                    continue
                runs.append(longest_passage(equal))
                best = max(best, runs[-1])
                if best >= least:
                    break
            # Words left out or put in move a passage to another diagonal: its parts then lie on near ones.
            if sequence.is_query and best < least:
                for near, total in near_diagonals(places, runs):
                    if total >= least:
                        a, b = max(low, near[0] - 4), min(high, near[-1] + n + 4)
                        best = max(best, edited_passage(words, hashes[a:b]))
            if best >= least:
                found.add((text, sequence.item))
        return found


def near_diagonals(places: list[int], runs: list[int]) -> list[tuple[list[int], int]]:
    """Groups of two or more diagonals that lie near each other, and the sum of their longest runs. A text may hold a passage in several places."""
    order = sorted(range(len(places)), key=places.__getitem__)
    groups: list[list[int]] = []
    for i in order:
        if groups and places[i] - places[groups[-1][-1]] <= NEAR:
            groups[-1].append(i)
        else:
            groups.append([i])
    return [([places[i] for i in g], sum(runs[i] for i in g)) for g in groups if len(g) > 1]


def longest_passage(equal: np.ndarray) -> int:
    """Longest run of equal words in which single ones may differ (none next to each other, none at the ends, one in seven at most)."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0
    breaks = np.flatnonzero(np.diff(at) > 2)
    begin = np.concatenate(([0], breaks + 1))
    end = np.concatenate((breaks, [len(at) - 1]))
    length = at[end] - at[begin] + 1
    close = (end - begin + 1) * EDITED >= length * (EDITED - 1)
    return int(length[close].max()) if close.any() else 0


def edited_passage(words: np.ndarray, text: np.ndarray) -> int:
    """Most words of the sequence in one passage of the text at a small edit distance: a local alignment.

    A word that differs, is missing or is added costs as much as three that agree, so passages are joined over single
    edits and not over templates with other words in them. The words counted are those of the best alignment.
    """
    best, row = (0, 0), [(0, 0)] * (len(text) + 1)
    text = text.tolist()
    for w in words.tolist():
        new = [(0, 0)]
        for j, t in enumerate(text):
            score, held = row[j]
            option = (score + 1, held + 1) if w == t else (score - 3, held)
            for score, held in ((row[j + 1][0] - 3, row[j + 1][1]), (new[j][0] - 3, new[j][1])):
                if score > option[0]:
                    option = (score, held)
            if option[0] <= 0:
                option = (0, 0)
            if option > best:
                best = option
            new.append(option)
        row = new
    return best[1]


def leaked_items(texts: DataFrame, items: DataFrame, key: str, text: str, item_key: str = "id") -> DataFrame:
    """key and item_id of every text that holds an item. Texts are read once for each block of items and not shuffled."""
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    def search(part: list) -> DataFrame:
        index = spark.sparkContext.broadcast(ItemIndex(part))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bodies = batch.column(1).to_pylist()
                for begin, some in blocks(bodies):
                    found = sorted(index.value.verified(TextBlock([without_markup(x) for x in some])))
                    at = pa.array([begin + t for t, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([i for _, i in found], pa.string())], ["key", "item_id"])

        chosen = texts.select(texts[key].alias("key"), texts[text].alias("text"))
        return chosen.mapInArrow(run, f"key {kind}, item_id string").withColumnRenamed("key", key)

    # Wording is what several items share, so all items' queries are seen together: one bounded table.
    rows = [(str(r["id"]), r["query"], r["choices"]) for r in items.select(items[item_key].alias("id"), "query", "choices").limit(MOST_ITEMS + 1).toLocalIterator()]
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS:,} items: search them in parts")
    parts: list[list[Sequence_]] = [[]]
    size = 0
    for s in item_sequences(rows):
        if len(parts[-1]) >= MAX_ITEMS or parts[-1] and size + len(s.words) > MAX_WORDS:
            parts.append([])
            size = 0
        parts[-1].append(s)
        size += len(s.words)
    out = search(parts[0])
    for part in parts[1:]:
        out = out.unionByName(search(part))
    # the sequences of one item may lie in two blocks; within one, a text gives an item once
    return out.distinct()
