"""Reproducible samples and splits: rows are ordered by a hash of seed and key, never by a generator's state."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_index, keyed_hash


def hash_share(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the key's hash."""
    return F.conv(F.substring(keyed_hash(seed, *key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def hold_out(df: DataFrame, key: list[str], seed: int, n: int) -> DataFrame:
    """Adds is_held: whether the row's key is among the n keys with the smallest hashes. All rows of a key go one way.

    The n keys are found by a top-n, which needs no sort of all keys; the flag comes by a join.
    """
    held = df.select(*key).distinct().withColumn("_h", keyed_hash(seed, *(F.col(k) for k in key))).orderBy("_h").limit(n).select(*key, F.lit(True).alias("is_held"))
    return df.join(held, key, "left").na.fill({"is_held": False})


def ratio_split(share: float, seed: int, *key: Column) -> Column:
    """validation for this share of the keys, else train."""
    return F.when(hash_share(seed, *key) < share, "validation").otherwise("train")


def mixture_draw(weights: dict[str, float], seed: int, *key: Column) -> Column:
    """For each row the name of the source to draw from, by normalised weights."""
    total = sum(weights.values())
    if not weights or total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative and must sum to more than 0")
    u = hash_share(seed, *key)
    names = list(weights)
    out = F.lit(names[-1])
    for name, edge in reversed(list(zip(names, accumulate(w / total for w in weights.values())))[:-1]):
        out = F.when(u < edge, name).otherwise(out)
    return out


def balanced_pool(df: DataFrame, key: str, label: str, seed: int, n: int) -> DataFrame:
    """n examples, label by label in turn: the first of each label, then the second, larger labels first. Adds turn.

    A label can give n rows at most, so only its first n by hash take part.
    """
    own = Window.partitionBy(label).orderBy(keyed_hash(seed, F.col(key)))
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    ranked = df.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= n).join(sizes, label)
    return ranked.orderBy("turn", F.col("_size").desc(), label).limit(n).drop("_size")


def multi_epoch_files(files: DataFrame, name: str, seed: int, folders: int) -> DataFrame:
    """name and folder (from 1) of each file after a shuffle of all: rank by hash, dealt in turn. The rank is taken over range partitions."""
    ranked = global_index(files.select(name, keyed_hash(seed, F.col(name)).alias("__h")), ["__h", name])
    return ranked.select(name, ((F.col("global_index") + 1) % folders + 1).cast("bigint").alias("folder"))


def sequential_pool(df: DataFrame, order: list[str], n: int, seed: int = 0) -> DataFrame:
    """The rows in order, rotated by n for each seed: place 0 is the first example of this seed. All rows stay; only keys and numbers are ordered.

    The number of rows is taken from the files.
    """
    rows = max(df.count(), 1)
    return global_index(df, list(order)).withColumn("place", F.pmod(F.col("global_index") - n * seed, F.lit(rows)).cast("bigint")).drop("global_index")


def random_pool(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """The rows in an order by keyed hash; seed 0 keeps that of the keys. Adds place."""
    hashed = df.withColumn("__h", keyed_hash(seed, *map(F.col, key))) if seed else df.withColumn("__h", F.lit(""))
    return global_index(hashed, ["__h", *key]).withColumnRenamed("global_index", "place").drop("__h")


def few_shots(items: DataFrame, pool: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """key, place (from 0) and example of each item: the first n of its group's pool that are not itself.

    Of each group's pool only the first n + 1 rows by place take part, so the join gives at most n + 1 rows an item, whatever the groups' sizes.
    """
    own = Window.partitionBy(group).orderBy("place")
    first = pool.select(group, F.col(key).alias("example"), "place").withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= n + 1).select(group, "example", "turn")
    pairs = items.select(group, key).join(first, group).where(F.col(key) != F.col("example"))
    # without the item itself, those behind it move up by one
    self_turn = first.select(F.col("example").alias(key), F.col("turn").alias("__own"), group)
    placed = pairs.join(self_turn, [group, key], "left")
    place = F.col("turn") - F.when(F.col("turn") > F.col("__own"), 1).otherwise(0)
    return placed.select(key, (place - 1).cast("bigint").alias("place"), "example").where(F.col("place") < n)


#: Parts of the names of splits that examples may come from, in order of preference.
EXAMPLE_SPLITS = ("train", "dev", "valid", "default")


def example_split(available: list[str], evaluated: list[str]) -> str | None:
    """The split to take examples from: the first by kind that is not evaluated; None if there is none."""
    free = [s for s in available if s not in evaluated]
    return next((s for kind in EXAMPLE_SPLITS for s in free if kind in s), None)


def expanded_tasks(names: str, groups: dict[str, list[str]]) -> list[str]:
    """Names of tasks and of groups of tasks between commas, as tasks; name|n keeps its number of examples for every task of a group. Each comes once, in order."""
    out: dict[str, None] = {}
    for name in filter(None, map(str.strip, names.split(","))):
        base, bar, shots = name.partition("|")
        for task in groups.get(base, [base]):
            out[f"{task}{bar}{shots}"] = None
    return list(out)


def checked_schedule(config: dict) -> dict:
    """The configuration of a mixture of sources, if it holds together: names without repeats, one for each source, and of every stage as many weights."""
    if "names_weights" in config:
        return config
    count, names = len(config["sources"]), config["names"]
    if len(names) != count or len(set(names)) != count:
        raise ValueError(f"{count} sources need as many different names, not {names}")
    for stage in config["schedule"]:
        kind = stage["schedule_type"]
        if kind not in ("const", "changing"):
            raise ValueError(f"unknown kind of stage {kind!r}")
        for field in ("weights",) if kind == "const" else ("init_weights", "end_weights"):
            if len(stage[field]) != count:
                raise ValueError(f"{field} has {len(stage[field])} entries for {count} sources")
    if len(config.get("concat_sources", config["sources"])) != count:
        raise ValueError("concat_sources must have an entry for each source")
    return config


def shuffled_blocks(blocks: DataFrame, file: str, block: str, files_a_buffer: int, seed: int) -> DataFrame:
    """file, block, buffer and place: the order in which a reader gets blocks that it shuffles within buffers of so many files.

    Files are buffered in the order of their names. If the last files do not fill a buffer, it begins anew with the first ones: those are read again, and the
    files left over are not read in this pass. The place within the buffer is taken over range partitions.
    """
    ranked = global_index(blocks.select(file).distinct(), [file]).withColumnRenamed("global_index", "__rank")
    files = ranked.count()
    whole = files // files_a_buffer
    numbered = ranked.withColumn("buffer", F.floor(F.col("__rank") / files_a_buffer).cast("bigint"))
    read = numbered.where(F.col("buffer") < whole)
    if files % files_a_buffer and whole:
        read = read.unionByName(ranked.where(F.col("__rank") < files_a_buffer).withColumn("buffer", F.lit(whole).cast("bigint")))
    elif not whole:
        read = numbered  # fewer files than a buffer holds: all of them
    rows = blocks.select(file, block).join(read.drop("__rank"), file)
    return global_index(rows.withColumn("__h", keyed_hash(seed, F.col("buffer"), F.col(file), F.col(block))), ["buffer", "__h", file, block]).withColumnRenamed("global_index", "place").drop("__h")
