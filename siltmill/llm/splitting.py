"""Problem 6: cutting long texts into pieces under a limit, at natural boundaries, with overlap.

Dynamic programming over the boundaries of a text: the cost of a cut is the coarseness it lacks (a paragraph's end
costs nothing, the middle of a word most), the cost of a piece is how far its size is from an even division. Among all
ways to cut within the limit at boundaries, the cheapest is taken; of equal ones the first found. A word is cut only
where no boundary is in reach. A narrow search (of each cut's reach the coarsest kind in its farther part) bounds the
cost first; the full one leaves out what costs more, so a long text costs about in proportion to its length.

Results: a limit that is null, 0 or below leaves a text whole, as do null and empty texts (one empty piece). A piece has
the limit's number of characters at most; from the second on it begins exactly `overlap` characters before the end of
the one before. A null or negative overlap is 0; one that is not below the limit cannot be kept: it becomes half of the
limit, and overlap_kept is false in the text's rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost of a cut after a paragraph, a line, a sentence, a clause, a word, or anywhere.
CUT_COSTS = (0.0, 0.1, 0.25, 0.8, 1.5, 5.0)
#: Weight of the squared relative distance of a piece from the even size.
IMBALANCE = 1.0
#: The narrow search uses a kind of boundary if it occurs behind this part of the reachable stretch.
FAR_PART = 0.4

_SPACES = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")


def boundaries(text: str) -> list[list[int]]:
    """For each kind (paragraph, line, sentence, clause, word) the positions a piece may end at: behind white space."""
    kinds: list[list[int]] = [[], [], [], [], []]
    for m in _SPACES.finditer(text):
        at, end = m.span()
        breaks = text.count("\n", at, end)
        if breaks > 1:
            kind = 0
        elif breaks or "\r" in m.group():
            kind = 1
        elif _SENTENCE.search(text, max(0, at - 6), at):
            kind = 2
        elif at and text[at - 1] in ",;:–—":
            kind = 3
        else:
            kind = 4
        if 0 < end < len(text):
            kinds[kind].append(end)
    return kinds


def _whole_character(text: str, at: int, least: int) -> int:
    """A position at or before `at` that does not stand before a combining mark or inside a joined sequence."""
    while at > least and (unicodedata.category(text[at]).startswith("M") or text[at] == "‍" or text[at - 1] == "‍"):
        at -= 1
    return at


def _search(text: str, kinds: list[list[int]], limit: int, overlap: int, most: float, narrow: bool) -> tuple[float, list[int]]:
    """The cheapest ends of pieces whose cost is at most `most`, and the cost. narrow: of each cut's reach only the coarsest kind in the farther part is tried."""
    n = len(text)
    pieces = -(-(n - overlap) // (limit - overlap))
    even = (n - overlap) / pieces + overlap
    weight = IMBALANCE / limit**2
    # positions at least as coarse as a kind
    tiers = [sorted(x for k in kinds[: i + 1] for x in k) for i in (1, 2, 3, 4)] if narrow else []
    best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
    cost_at = {x: CUT_COSTS[k] for k, positions in enumerate(kinds) for x in positions}
    end_cost, end_from = float("inf"), -1
    queue, done = [0], set()
    while queue:
        at = heapq.heappop(queue)
        if at in done:
            continue
        done.add(at)
        cost, _ = best[at]
        start = at - overlap if at else 0
        reach = start + limit
        if reach >= n:
            total = cost + weight * (n - start - even) ** 2
            if total < end_cost:
                end_cost, end_from = total, at
            continue
        found: list[int] = []
        if narrow:
            far = at + (reach - at) * FAR_PART
            for tier in tiers:
                high = bisect_right(tier, reach)
                low = bisect_left(tier, max(at + 1, far))
                if high > low:
                    found = tier[low:high]
                    break
        none = not found
        if not narrow or none:
            for k, positions in enumerate(kinds):
                low, high = bisect_right(positions, at), bisect_right(positions, reach)
                none = none and high == low
                if cost + CUT_COSTS[k] <= most:
                    found += positions[low:high]
        if none:
            found = [_whole_character(text, reach, at + 1)]
            cost_at.setdefault(found[0], CUT_COSTS[5])
        for to in found:
            total = cost + cost_at[to] + weight * (to - start - even) ** 2
            if total > most:
                continue
            old = best.get(to)
            if old is None:
                heapq.heappush(queue, to)
            if old is None or total < old[0]:
                best[to] = (total, at)
    ends, at = [n], end_from
    while at > 0:
        ends.append(at)
        at = best[at][1]
    ends.reverse()
    return end_cost, ends


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of a text longer than the limit.

    A narrow search gives a way to cut and its cost; the full one then leaves out only cuts that cost more alone.
    """
    kinds = boundaries(text)
    cost, _ = _search(text, kinds, limit, overlap, float("inf"), narrow=True)
    _, ends = _search(text, kinds, limit, overlap, cost + 1e-9, narrow=False)
    return [(ends[i - 1] - overlap if i else 0, end) for i, end in enumerate(ends)]


def pieces_of(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """Start and end of the pieces of any text; see the module's results."""
    text = text or ""
    if limit is None or limit <= 0 or len(text) <= limit:
        return [(0, len(text))]
    overlap = max(overlap or 0, 0)
    return cut_points(text, limit, overlap if overlap < limit else limit // 2)


def split_texts(df: DataFrame, key: str, text: str, limit: str, overlap: str, with_text: bool = True) -> DataFrame:
    """key, piece (from 0), pieces, start, end, overlap_kept and (with_text) the piece itself, of every row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, limits, overlaps = (batch.column(i).to_pylist() for i in (1, 2, 3))
            rows, piece, count, begin, end, kept, parts, size = [], [], [], [], [], [], [], 0
            for i, (t, most, shared) in enumerate(zip(texts, limits, overlaps)):
                found = pieces_of(t, most, shared)
                rows += [i] * len(found)
                piece += range(len(found))
                count += [len(found)] * len(found)
                begin += [a for a, _ in found]
                end += [b for _, b in found]
                kept += [len(found) == 1 or (shared or 0) < most] * len(found)
                if with_text:
                    parts += [(t or "")[a:b] for a, b in found]
                    size += sum(b - a for a, b in found)
                if size > 4_000_000 or len(rows) > 50_000 or i == len(texts) - 1:
                    columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(count, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(kept, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.string())] * with_text, ["key", "piece", "pieces", "start", "end", "overlap_kept", "piece_text"][: 6 + with_text])
                    rows, piece, count, begin, end, kept, parts, size = [], [], [], [], [], [], [], 0

    schema = f"key {df.schema[key].dataType.simpleString()}, piece int, pieces int, start int, end int, overlap_kept boolean" + ", piece_text string" * with_text
    chosen = df.select(df[key].alias("key"), df[text].alias("text"), df[limit].cast("int").alias("limit"), df[overlap].cast("int").alias("overlap"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)


def must_split(df: DataFrame, key: str, text: str, limit: str, overlap: str) -> DataFrame:
    """Keys of the rows that come out as more than one piece."""
    return split_texts(df, key, text, limit, overlap, with_text=False).where((F.col("piece") == 0) & (F.col("pieces") > 1)).select(key)
