"""Shards of rows: finding, reading, normalising, writing, merging and splitting them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions.text import filled, first_filled, lines, token_estimate

#: Characters of a row's JSON that stand for its text, where it has no text column.
JSON_CHARS = 1_000_000


def shard_paths(folder: str) -> list[str]:
    """All Parquet files below the folder in order of their paths; the compressed JSON lines only if there are none. For folders that the driver can list."""
    root = Path(folder)
    found = sorted(root.rglob("*.parquet")) or sorted(root.rglob("*.jsonl.zst"))
    if not found:
        raise FileNotFoundError(f"no *.parquet and no *.jsonl.zst below {folder}")
    return [str(p) for p in found]


def file_share(paths: list[str], share: float) -> list[str]:
    """The first part of a list of files."""
    return paths[: int(len(paths) * share)]


def read_shards(spark: SparkSession, paths: list[str], schema: K.StructType | str | None = None) -> DataFrame:
    """Rows of Parquet or (compressed) JSON-lines files with the file's path as `shard`. A schema saves the pass that finds one out."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    parquet = [p for p in paths if p.endswith(".parquet")]
    if parquet and len(parquet) != len(paths):
        raise ValueError("shards are either all Parquet or all JSON lines")
    rows = reader.parquet(*paths) if parquet else reader.option("mode", "PERMISSIVE").json(paths)
    return rows.withColumn("shard", F.input_file_name())


def read_parquet_with_positions(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet rows with shard (file path) and row_index (position in the file), which hold however the files are divided among tasks."""
    return spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("shard"), F.col("_metadata.row_index").alias("row_index"))


def read_json_lines(spark: SparkSession, path: str | list[str], schema: K.StructType | str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines, plain or compressed. Bad lines and files are skipped, or, if strict, end the job."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("ignoreCorruptFiles", str(not strict).lower()).json(path)
    return rows


def text_column(df: DataFrame, dataset_type: str) -> Column:
    """The text of a row by the kind of its data set."""
    has = set(df.columns)
    string = lambda c: F.col(c) if isinstance(df.schema[c].dataType, K.StringType) else F.lit("")
    if dataset_type in ("plain", "fineweb", "dclm"):
        return filled(string("text")) if "text" in has else F.lit("")
    if dataset_type in ("raw_content", "redpajama", "redpajamav2"):
        return first_filled(*(string(c) for c in ("raw_content", "text") if c in has), F.lit(""))
    if dataset_type == "passthrough":
        whole = F.substring(F.to_json(F.struct("*")), 1, JSON_CHARS)
        return F.coalesce(string("text"), whole) if "text" in has else whole
    raise ValueError(f"unknown data set type {dataset_type!r}")


def raw_content_document(df: DataFrame, most_tokens: int, tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """text (empty over the token limit), id (hash of the text) and the other columns as meta."""
    raw = filled(F.col("raw_content"))
    rest = [c for c in df.columns if c != "raw_content"]
    meta = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest))) if rest else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.select(F.when(tokens(raw) <= most_tokens, raw).otherwise("").alias("text"), F.sha2(raw, 256).alias("id"), meta.alias("meta"))


def math_document(df: DataFrame, most_lines: int) -> DataFrame:
    """text (empty over the line limit) under one id."""
    text = filled(F.col("text"))
    return df.select(F.when(F.size(lines(text)) <= most_lines, text).otherwise("").alias("text"), F.lit("0").alias("id"))


#: Adapters by name of the data set; the others take rows as they are.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {"redpajama": raw_content_document, "openwebmath": math_document}


def lower_names(df: DataFrame) -> DataFrame:
    """Column names in lower case."""
    return df.withColumnsRenamed({c: c.lower() for c in df.columns if c != c.lower()})


def flat_columns(schema: K.StructType, prefix: str = "") -> list[Column]:
    """Leaves of nested structs as columns named a/b/c."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
        out += flat_columns(f.dataType, path) if isinstance(f.dataType, K.StructType) else [F.col(path).alias(path.replace("`", "").replace(".", "/"))]
    return out


def write_shards(df: DataFrame, path: str, rows_a_file: int | None = None, shard: str | None = None, codec: str = "zstd") -> None:
    """Parquet files of at most rows_a_file rows, in a folder for each shard if a column is given."""
    writer = df.write.mode("overwrite").option("compression", codec)
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(shard) if shard else writer).parquet(path)


def merge_ranks(spark: SparkSession, folders: list[str], target: str) -> int:
    """Rank folders (name_0, name_1, ..., in the order of their numbers) into one sorted Parquet data set; the number of rows, which must not be 0."""
    number = lambda p: int(p.rstrip("/").rsplit("_", 1)[1])
    merged = None
    for folder in sorted(folders, key=number):
        rows = read_parquet_with_positions(spark, folder).withColumn("rank", F.lit(number(folder)))
        merged = rows if merged is None else merged.unionByName(rows)
    if merged is None or not (count := merged.count()):
        raise ValueError("there are no rows to merge")
    merged.repartitionByRange("rank", "shard", "row_index").sortWithinPartitions("rank", "shard", "row_index").drop("rank", "shard", "row_index").write.mode("overwrite").parquet(target)
    return count


def write_text_files(df: DataFrame, folder: str, name: str, texts: list[str]) -> DataFrame:
    """A text file for each row and column in a folder that all executors share; the manifest."""
    import pyarrow as pa

    def run(batches):
        root = Path(folder)
        root.mkdir(parents=True, exist_ok=True)
        for b in batches:
            names, files = b.column(0).to_pylist(), []
            for i, n in enumerate(names):
                for j, c in enumerate(texts, 1):
                    (root / f"{n}_{c}.txt").write_text(b.column(j)[i].as_py() or "", encoding="utf-8")
                files.append(str(root / f"{n}_{texts[0]}.txt"))
            yield pa.RecordBatch.from_arrays([pa.array(map(str, names), pa.string()), pa.array(files, pa.string())], ["name", "file"])

    return df.select(name, *texts).mapInArrow(run, "name string, file string")


def fingerprint(settings: Mapping[str, Any], without: tuple[str, ...] = ("max_docs", "max_chars", "max_chunks")) -> str:
    """Hash of a run's settings, caps left out, by which a later run knows whether it may go on from its output."""
    kept = {k: v for k, v in settings.items() if k not in without}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows not written yet."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def with_cached(todo: DataFrame, cache: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache's rows and those computed for what it lacks; rows of the cache win."""
    return cache.join(todo.select(*key).distinct(), key, "left_semi").unionByName(compute(remaining(todo, cache, key)))


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Settings with those of `over` laid on top, mappings merged throughout."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def latest_run(results: DataFrame, key: list[str], run: str, first: bool = False) -> DataFrame:
    """The rows of each key's last (or first) run; run names are ISO times and sort as such."""
    pick = F.min(run) if first else F.max(run)
    return results.join(results.groupBy(*key).agg(pick.alias(run)), [*key, run], "left_semi")


def write_json_lines(df: DataFrame, path: str, codec: str | None = "gzip") -> None:
    """A JSON object a line, nulls written too, in the files of a folder."""
    df.write.mode("overwrite").option("compression", codec or "none").option("ignoreNullFields", "false").json(path)


def write_statistics(stats: DataFrame, path: str, rank: int) -> None:
    """The statistics of one rank's run as JSON, in its part of the folder; a run again takes its place."""
    write_json_lines(stats.withColumn("rank", F.lit(rank)).coalesce(1), f"{path}/stats_rank={rank}", None)


def read_statistics(spark: SparkSession, path: str, schema: K.StructType | str | None = None) -> DataFrame:
    """The statistics of all ranks, with the rank that each file says; files may have one object over several lines."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return rows


def write_results(results: DataFrame, path: str, task: str, run: str, run_name: str) -> None:
    """Details of a run by task and run; results of other runs in the folder stay."""
    own = results.withColumn(run, F.lit(run_name))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task, run).parquet(path)


def read_results(spark: SparkSession, path: str, task: str, run: str, first: bool = False) -> DataFrame:
    """Details of each task's last (or first) run. Which that is comes from the folders' names; other runs' files are not read."""
    rows = spark.read.option("basePath", path).option("inferSchema", "false").parquet(path)
    rows = rows.withColumn(run, F.col(run).cast("string"))
    return latest_run(rows, [task], run, first)


def adapted(df: DataFrame, dataset: str, *limits: int) -> DataFrame:
    """The rows as the data set's adapter makes them; of a data set without one as they are."""
    return ADAPTERS[dataset](df, *limits) if dataset in ADAPTERS else df


def read_adapted(spark: SparkSession, path: str | list[str], dataset: str, *limits: int, schema: K.StructType | str | None = None) -> DataFrame:
    """JSON lines, plain or compressed, read and adapted."""
    return adapted(read_json_lines(spark, path, schema), dataset, *limits)
