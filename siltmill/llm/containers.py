"""Problem 8: filling containers of a fixed capacity with texts.

Items of one size are alike, so the packing is worked out over the number of items of each size, a table that cannot
be longer than the capacity however many texts there are. Dominance fixes what any optimal packing may contain (an
item with the item that fills its container exactly; an item that nothing fits beside; an item with the largest one
that fits where no two others together could do better), then best fit, largest first, places the rest. The plan is a
list of runs of equal containers. Each item then finds its container from its rank among the items of its size; ranks
come from counts of blocks of items and from positions within a block, so a size that half of all texts share is
never gathered in one task.

Results: a text over the capacity is divided into full containers and a rest; a null or empty text has no tokens and
comes out as one piece of size 0 in container 0. Each piece is in exactly one container.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: Runs of equal containers: number of containers, and (size, times) of what each holds.
Plan = list[tuple[int, list[tuple[int, int]]]]


def dominant(counts: dict[int, int], capacity: int) -> Plan:
    """Fixes sets of items that dominate every other set with the same largest item; takes them out of counts."""
    plan: Plan = []

    def take(containers: int, *sizes: int) -> None:
        held: dict[int, int] = {}
        for s in sizes:
            held[s] = held.get(s, 0) + 1
        for s, times in held.items():
            counts[s] -= times * containers
            if not counts[s]:
                del counts[s]
        plan.append((containers, sorted(held.items(), reverse=True)))

    # Exact pairs (and full containers): whatever else stands with the larger item can be exchanged for its partner.
    for size in sorted(counts, reverse=True):
        if size == capacity:
            take(counts[size], size)
        elif size * 2 > capacity:
            both = min(counts.get(size, 0), counts.get(capacity - size, 0))
            if both:
                take(both, size, capacity - size)
        elif size * 2 == capacity and counts.get(size, 0) > 1:
            take(counts[size] // 2, size, size)
    # From the largest on: nothing fits beside it, or at most one item and the largest that fits is the best of these. Where that fails for one size, it may
    # hold for a smaller one, beside which a larger item may stand; so all sizes are gone through, again as long as any was fixed.
    changed = True
    while changed and counts:
        changed = False
        order = sorted(counts)
        for size in order[::-1]:
            while size in counts and (held := _dominating(size, order, counts, capacity)):
                take(*held)
                order = [s for s in order if s in counts] if len(counts) != len(order) else order
                changed = True
    return plan


def _dominating(size: int, order: list[int], counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """How many containers hold an item of this size with what dominates all else beside it, and the sizes held; None where nothing does. order: all sizes."""
    free = capacity - size
    if order[0] > free or (len(order) == 1 and counts[size] == 1):
        return (counts[size] if order[0] > free else 1), size
    end = bisect.bisect_right(order, free)
    single = counts[size] < 2 and size <= free
    fitting = [s for s in order[:end] if s != size] if single else order[:end]
    if not fitting:
        return 1, size
    partner, smallest = fitting[-1], fitting[0]
    second = smallest if counts[smallest] > 1 + (smallest == size) else (fitting[1] if len(fitting) > 1 else capacity)
    if smallest + second > free or partner >= _best_pair(fitting, counts, free):
        return (counts[size] // 2, size, size) if size == partner else (min(counts[size], counts[partner]), size, partner)
    return None


def _best_pair(sizes: list[int], counts: dict[int, int], free: int) -> int:
    """Largest sum of any number of the sizes, two at least, that is no more than free; free if three may fit."""
    if len(sizes) and sizes[0] * 3 <= free:
        return free
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:
        if low == high and counts[sizes[low]] < 2:
            break
        total = sizes[low] + sizes[high]
        if total <= free:
            best, low = max(best, total), low + 1
        else:
            high -= 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit of the items by falling size, on runs of equal containers."""
    by_free: dict[int, list[tuple[int, tuple]]] = {}
    frees: list[int] = []

    def put(free: int, containers: int, held: tuple) -> None:
        if free not in by_free:
            by_free[free] = []
            bisect.insort(frees, free)
        by_free[free].append((containers, held))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(frees, size)
            if at == len(frees):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, left // each, ((size, each), ()))
                    left %= each
                if left:
                    put(capacity - left * size, 1, ((size, left), ()))
                break
            free = frees[at]
            containers, held = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                frees.pop(at)
            # As best fit has it: after one item went in, the same container is the tightest for the next one too.
            each = min(free // size, left)
            used = min(containers, left // each)
            put(free - each * size, used, ((size, each), held))
            left -= each * used
            if containers > used:
                put(free, containers - used, held)
    plan: Plan = []
    for runs in by_free.values():
        for containers, chain in runs:
            held: dict[int, int] = {}
            while chain:
                (size, times), chain = chain
                held[size] = held.get(size, 0) + times
            plan.append((containers, sorted(held.items(), reverse=True)))
    return plan


def pack_counts(counts: dict[int, int], capacity: int) -> Plan:
    """Plan for items of 1 to capacity tokens."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("sizes must lie between 1 and the capacity")
    return dominant(counts, capacity) + best_fit(counts, capacity)


def _places(plans: dict[int, Plan]) -> dict[int, dict[int, np.ndarray]]:
    """Of each pack and size: columns first rank, first container, items in a container, in rank order."""
    out: dict[int, dict[int, np.ndarray]] = {}
    for pack, plan in plans.items():
        rows: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for containers, held in plan:
            for size, times in held:
                rows.setdefault(size, []).append((ranks.get(size, 0), base, times))
                ranks[size] = ranks.get(size, 0) + containers * times
            base += containers
        out[pack] = {size: np.array(x, np.int64) for size, x in rows.items()}
    return out


def pack_texts(sizes: DataFrame, config: DataFrame, key: str = "doc_id", size: str = "tokens", block_rows: int = 100_000) -> DataFrame:
    """pack_id, capacity, key, piece, piece_tokens, container of every piece of every row of sizes, for each row of config.

    sizes: one row a text with its number of tokens. config: pack_id, capacity; a small table of settings (at most
    1,000 rows, which is checked). block_rows: items in a block within which positions are counted.
    """
    spark = sizes.sparkSession
    packs = {r["pack_id"]: int(r["capacity"]) for r in config.select("pack_id", "capacity").distinct().limit(1001).collect()}
    if len(packs) > 1000 or any(c < 1 for c in packs.values()):
        raise ValueError("config must hold at most 1,000 packs with a capacity of 1 or more")
    kind = sizes.schema[key].dataType.simpleString()
    schema = f"pack_id int, capacity int, {key} {kind}, piece bigint, piece_tokens int, container bigint"
    if not packs:
        return spark.createDataFrame([], schema)
    kept = durable(sizes.select(sizes[key].alias("k"), F.coalesce(sizes[size], F.lit(0)).cast("bigint").alias("n")))
    # Positions are counted within (number of tokens, block of texts): a block is a hash of the key, so it is the same however often a task runs.
    histogram = kept.groupBy("n").agg(F.count("*").alias("texts"))
    rows = kept.count()
    parts = max(1, -(-rows // block_rows))
    # Long texts: what is left over after full containers.
    by_pack = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("capacity")) for p, c in sorted(packs.items())]))
    pieces = histogram.select("n", "texts", by_pack.alias("p")).select("p.*", "n", "texts")
    whole = pieces.select("pack_id", "capacity", F.expr("n div capacity").alias("full"), F.expr("n % capacity").alias("rest"), "texts")
    found = whole.groupBy("pack_id", "capacity", "rest").agg(F.sum("texts").alias("items"), F.sum(F.col("full") * F.col("texts")).alias("full"))
    plans: dict[int, Plan] = {}
    counts: dict[int, dict[int, int]] = {p: {} for p in packs}
    full: dict[int, int] = dict.fromkeys(packs, 0)
    for r in found.toLocalIterator():  # at most one row a pack and size below its capacity
        if r["rest"]:
            counts[r["pack_id"]][r["rest"]] = r["items"]
        full[r["pack_id"]] += r["full"]
    for p, c in packs.items():
        plans[p] = pack_counts(counts[p], c)
    first_full = {p: sum(m for m, _ in plan) for p, plan in plans.items()}
    where = _places(plans)
    shared = spark.sparkContext.broadcast((where, first_full))

    items = kept.select("k", "n", F.pmod(F.xxhash64("k"), F.lit(parts)).alias("part"), by_pack.alias("p")).select("k", "n", "part", "p.*")
    items = items.select("k", "part", "pack_id", "capacity", F.expr("n div capacity").alias("full"), F.expr("n % capacity").cast("int").alias("rest"))
    group = ["pack_id", "rest", "part"]
    totals = items.groupBy(*group).agg(F.count("*").alias("here"), F.sum("full").alias("full_here"))
    before = Window.partitionBy("pack_id", "rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # full containers are numbered over all rests of a pack: one small row for each (pack, rest), a prefix sum over these
    of_rest = totals.groupBy("pack_id", "rest").agg(F.sum("full_here").alias("rest_full"))
    rest_before = of_rest.select("pack_id", "rest", F.coalesce(F.sum("rest_full").over(Window.partitionBy("pack_id").orderBy("rest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rest_before"))
    starts = totals.select(*group, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("rank_before"), F.coalesce(F.sum("full_here").over(before), F.lit(0)).alias("full_before"))
    starts = starts.join(rest_before, ["pack_id", "rest"])
    own = Window.partitionBy(*group).orderBy("k")
    ranked = items.select("*", (F.row_number().over(own) - 1).alias("own_rank"), (F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("full")).alias("own_full"))
    ranked = ranked.join(starts, group).select("pack_id", "capacity", "k", "full", "rest", (F.col("rank_before") + F.col("own_rank")).alias("rank"), (F.col("rest_before") + F.col("full_before") + F.col("own_full")).alias("full_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, first_full = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pack, capacity, full, rest, rank, full_rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("pack_id", "capacity", "full", "rest", "rank", "full_rank"))
            container = np.zeros(len(pack), np.int64)
            code = pack.astype(np.int64) << 32 | rest
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order], prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                rows = order[a:b]
                if rest[rows[0]]:
                    table = where[int(pack[rows[0]])][int(rest[rows[0]])]
                    run = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
                    container[rows] = table[run, 1] + (rank[rows] - table[run, 0]) // table[run, 2]
            # one row for the rest (or for an empty text), and one for each full container
            has_rest = (rest > 0) | (full == 0)
            copies = full + has_rest
            source = np.repeat(np.arange(len(pack)), copies)
            piece = np.arange(len(source)) - np.repeat(np.cumsum(copies) - copies, copies)
            is_full = piece < full[source]
            base = np.array([first_full[int(p)] for p in pack], np.int64)
            number = np.where(is_full, base[source] + full_rank[source] + piece, container[source])
            yield pa.RecordBatch.from_arrays(
                [pa.array(pack[source], pa.int32()), pa.array(capacity[source], pa.int32()), batch.column(batch.schema.get_field_index("k")).take(pa.array(source)), pa.array(piece, pa.int64()), pa.array(np.where(is_full, capacity[source], rest[source]), pa.int32()), pa.array(number, pa.int64())],
                ["pack_id", "capacity", key, "piece", "piece_tokens", "container"],
            )

    return ranked.mapInArrow(place, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """By pack: pieces, tokens, containers, the fewest containers that could hold the tokens, and the unused share."""
    by_pack = packed.groupBy("pack_id", "capacity").agg(F.count("*").alias("pieces"), F.sum("piece_tokens").alias("tokens"), (F.max("container") + 1).alias("containers"))
    room = F.col("containers") * F.col("capacity")
    return by_pack.select("pack_id", "capacity", "pieces", "tokens", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), (1 - F.col("tokens") / room).alias("unused_share"))
