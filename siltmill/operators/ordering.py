"""Positions in a global order, shards, limits and caps, without bringing all rows or all of a shard into one task.

A running number or sum over all rows is taken over the rows in range partitions of even size, whatever their keys:
within each partition, and over the partitions' totals, of which there are as many as tasks. The partitions are written
once to the shared folder, as both phases must see the same ones. Only keys and sizes take part; texts are joined to
the result where they are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def with_prefix(df: DataFrame, order: list[Column | str], value: Column | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of `value` (rows, if none is given) over all rows that stand before in the order. Give narrow rows."""
    value = F.lit(1) if value is None else value
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.withColumn("__value", value).withColumns({f"__key{i}": k for i, k in enumerate(keys)})
    by = [f"__key{i}" for i in range(len(keys))]
    rows = durable(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(F.sum("__value").alias("__total"))
    starts = totals.select("__part", F.coalesce(F.sum("__total").over(parts), F.lit(0)).alias("__start"))
    done = rows.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0))).join(starts, "__part")
    return done.withColumn(name, (F.col("__start") + F.col("__own")).cast("bigint")).select(*df.columns, name)


def global_index(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Adds global_index, from 0."""
    return with_prefix(df, order, name="global_index")


def row_range_shard(index: Column, rows: Column, shards: int) -> Column:
    """The shard r whose range [rows*r div shards, rows*(r+1) div shards) holds the row."""
    return F.floor((F.lit(shards) * (index + 1) - 1) / rows).cast("bigint")


def round_robin_shard(index: Column, shards: int) -> Column:
    return F.pmod(index, F.lit(shards)).cast("bigint")


def batch_number(index: Column, size: int | None) -> Column:
    """Batch of fixed size; without a size above 0 there is one."""
    return F.lit(0).cast("bigint") if not size or size <= 0 else F.floor(index / size).cast("bigint")


def cap_prefix(df: DataFrame, order: list[Column | str], size: Column, most: int) -> DataFrame:
    """The longest prefix of the rows whose sizes sum to no more than `most`."""
    return with_prefix(df, order, size, "__before").where(F.col("__before") + size <= most).drop("__before")


def budget_prefix(df: DataFrame, order: list[Column | str], size: Column, target: int) -> DataFrame:
    """The rows until the target is reached, the one that reaches it included."""
    return with_prefix(df, order, size, "__before").where(F.col("__before") < target).drop("__before")


def nth_row(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The row with global index n. The index is taken over the keys alone; the row found is joined to its table."""
    found = global_index(df.select(*order), list(order)).where(F.col("global_index") == n)
    return df.join(F.broadcast(found), order)


def keyed_hash(seed: int, *key: Column) -> Column:
    """A reproducible random string for a key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)


def top_rows(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    """The n rows with the highest score; of equal scores the lowest tie key."""
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(n)


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the order. Partial results are merged, so a hot key is no sort in one task."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, "__row.*").select(*df.columns)


def last_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the last in the order."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, "__row.*").select(*df.columns)
