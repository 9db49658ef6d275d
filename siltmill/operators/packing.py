"""Token arrays in blocks of fixed length, sequence boundaries, balancing, and the packed file format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .ordering import with_prefix

#: The packed file's mark and version.
MARK, VERSION = b"LITPKDS", 1
#: Number types of the packed file by code.
TYPES = {1: np.uint8, 2: np.int8, 3: np.int16, 4: np.int32, 5: np.int64, 6: np.float32, 7: np.float64, 8: np.uint16}
HEADER = "<7sQBQ"


def pack_blocks(df: DataFrame, order: list[str], ids: str, size: int) -> DataFrame:
    """block and block_ids: all ids one after another, cut every `size`. The last block is left out if it is not full.

    order: columns that together are unique. The arrays are brought into order once, in range partitions of even size, and written to the shared folder;
    each partition knows from the others' totals where in the whole it begins, and cuts its blocks itself. Only the pieces of blocks that lie in
    two or more partitions are shuffled, two a partition.
    """
    keys = [F.col(o).alias(f"__key{i}") for i, o in enumerate(order)]
    by = [f"__key{i}" for i in range(len(order))]
    rows = df.select(*keys, F.col(ids).cast("array<bigint>").alias("__ids")).where(F.size("__ids") > 0)
    rows = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("__ids", F.spark_partition_id().alias("__part")))
    totals = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.sum(F.size("__ids")).alias("n")).collect()}  # a number for each task
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part] = at
        at += totals[part]
    kind = df.schema[ids].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        offset = count = 0
        begun = False

        def sent(values: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
            # values begin at `first` of the whole; whole blocks, and the pieces of others at both ends
            edges = [first, *range((first // size + 1) * size, first + len(values), size), first + len(values)]
            for i in range(0, len(edges) - 1, 1_000):
                part = edges[i : i + 1_001]
                lists = pa.ListArray.from_arrays(pa.array(np.array(part) - part[0], pa.int32()), pa.array(values[part[0] - first : part[-1] - first], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([e // size for e in part[:-1]], pa.int64()), pa.array(part[:-1], pa.int64()), lists], ["block", "at", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                offset, begun = starts[batch.column(1)[0].as_py()], True
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            held.append(values)
            count += len(values)
            # up to the last border of a block
            full = (offset + count) // size * size - offset
            if full >= 1 << 20:
                values = np.concatenate(held)
                yield from sent(values[:full], offset)
                held, offset, count = [values[full:]], offset + full, count - full
        if count:
            yield from sent(np.concatenate(held), offset)

    pieces = rows.select("__ids", "__part").mapInArrow(cut, "block bigint, at bigint, part array<bigint>")
    whole = F.size("part") == size
    joined = pieces.where(~whole).groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])).alias("part")).where(whole)
    return pieces.where(whole).select("block", "part").unionByName(joined).select("block", F.col("part").cast(kind).alias("block_ids"))


def sequences(ids: Column, size: int) -> Column:
    """Pairs x, y of the array: stretches of `size`, y one further on; an incomplete one at the end is left out."""
    count = F.floor((F.size(ids) - 1) / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.slice(ids, i * size + 1, size).alias("x"), F.slice(ids, i * size + 2, size).alias("y")))


#: Lengths that are summed at a time. Arrays are copied when they grow, so long ones grow in pieces.
PIECE = 256


def cumulative_lengths(lengths: Column) -> Column:
    """0 and the running sums: within pieces, with the sum of the pieces before carried into each."""
    pieces = lambda: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / PIECE).cast("int") - 1, F.lit(0))), lambda i: F.slice(lengths, i * PIECE + 1, PIECE))
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, n: a + n)
    grown = lambda x, start: F.aggregate(x, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    carried = grown(F.transform(pieces(), total), F.lit(0).cast("bigint"))
    sums = F.flatten(F.zip_with(pieces(), F.slice(carried, F.lit(1), F.size(carried) - 1), lambda p, start: F.slice(grown(p, start), F.lit(2), F.greatest(F.size(p), F.lit(1)))))
    return F.when(F.size(lengths) == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.concat(F.array(F.lit(0).cast("bigint")), sums))


def lengths_of(cumulative: Column) -> Column:
    return F.transform(F.slice(cumulative, 2, F.greatest(F.size(cumulative) - 1, F.lit(0))), lambda x, i: x - F.get(cumulative, i))


def position_ids(lengths: Column) -> Column:
    """0, 1, ... within each sequence."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))))


def without_tail(lengths: Column) -> Column:
    """The lengths without the run of ones at the end, which is padding."""
    kept = F.aggregate(F.transform(lengths, lambda n, i: F.when(n != 1, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.slice(lengths, 1, kept)


def packed_row(examples: Column, separator: int, most: int) -> Column:
    """Examples (ids and labels) one after another with a separator (label ignored) between them, cut at the limit."""
    gap = F.struct(F.array(F.lit(separator)).alias("ids"), F.array(F.lit(-100)).alias("labels"))
    spaced = F.flatten(F.transform(examples, lambda e, i: F.when(i == 0, F.array(e)).otherwise(F.array(gap, e))))
    cut = lambda name: F.slice(F.flatten(F.transform(spaced, lambda e: e[name])), 1, most)
    return F.struct(cut("ids").alias("ids"), cut("labels").alias("labels"))


def length_buckets(df: DataFrame, group: str, key: str, length: Column, buckets: int) -> DataFrame:
    """Adds place (by falling length within the group) and bucket (places in stretches of equal size, the last shorter).

    Places come from one order over all groups, so a group that holds most rows is many tasks.
    """
    placed = with_prefix(df, [group, -length, key], name="__at")
    sizes = placed.groupBy(group).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    placed = placed.join(sizes, group).withColumn("place", (F.col("__at") - F.col("__first")).cast("bigint"))
    return placed.withColumn("bucket", F.floor(F.col("place") / F.ceil(F.col("__rows") / buckets)).cast("bigint")).drop("__at", "__first", "__rows")


def sampler_rows(index: Column, rows: Column, replicas: int) -> tuple[Column, Column]:
    """Replica of a row, and how often it is read: the last row fills up the last turn."""
    short = F.pmod(-rows, F.lit(replicas))
    return F.pmod(index, F.lit(replicas)).cast("bigint"), F.when(index == rows - 1, 1 + short).otherwise(1).cast("bigint")


def balance(df: DataFrame, group: str, key: str, length: str, bins: int) -> DataFrame:
    """group, key, bin: longest first, each to the bin with the least sum of squared lengths. A group is one batch of training and fits in memory."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([length, key], ascending=[False, True])
        sums, out = [0] * bins, []
        for n in rows[length]:
            at = min(range(bins), key=lambda i: sums[i])
            sums[at] += int(n) ** 2
            out.append(at)
        return rows.assign(bin=pd.array(out, "int64"))[[group, key, "bin"]]

    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}
    return df.select(group, key, length).groupBy(group).applyInPandas(deal, f"{group} {kinds[group]}, {key} {kinds[key]}, bin bigint")


def write_packed(blocks: DataFrame, ids: str, folder: str, size: int, wide: bool = False) -> DataFrame:
    """Writes each partition's arrays of `size` ids as one packed file in the folder, which all executors must share; file and blocks of each."""
    code = 4 if wide else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        Path(folder).mkdir(parents=True, exist_ok=True)
        path, count = Path(folder) / f"part_{part:010d}.bin", 0
        spare = path.with_suffix(f".{TaskContext.get().taskAttemptId()}.tmp")
        with spare.open("wb") as f:
            f.write(struct.pack(HEADER, MARK, VERSION, code, size))
            for b in batches:
                for x in b.column(0).to_pylist():
                    f.write(np.asarray(x, TYPES[code]).tobytes())
                    count += 1
        spare.replace(path)  # a repeated task leaves one whole file
        yield pa.RecordBatch.from_arrays([pa.array([str(path)]), pa.array([count], pa.int64())], ["file", "blocks"])

    return blocks.select(ids).mapInArrow(run, "file string, blocks bigint")


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """file, block and ids of the packed files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mark, version, code, size = struct.unpack_from(HEADER, content)
                if mark != MARK or version != VERSION:
                    raise ValueError(f"{path} is no packed file of version {VERSION}")
                values = np.frombuffer(content, TYPES[code], offset=struct.calcsize(HEADER)).reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array(range(len(values)), pa.int64()), pa.array(values.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["file", "block", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, block bigint, ids array<int>")
