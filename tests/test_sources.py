import gzip
import json

import pytest
from pyspark.sql import functions as F

from siltmill.sources import shards
from siltmill.streaming import refine


def test_shards(spark, tmp_path):
    rows = [{"text": f"t{i}", "n": i} for i in range(6)]
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in rows[:3]) + "\n\n")
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(r) for r in rows[3:]) + "\n{broken")
    got = shards.read_json_lines(spark, [str(tmp_path / "a.jsonl.gz"), str(tmp_path / "b.jsonl")], "text string, n int")
    assert sorted(r["n"] for r in got.collect()) == list(range(6))
    with pytest.raises(FileNotFoundError):
        shards.shard_paths(str(tmp_path))


def test_positions_and_merge(spark, tmp_path):
    for rank in (10, 2):
        spark.createDataFrame([(rank, i) for i in range(5)], "r int, i int").coalesce(1).write.parquet(str(tmp_path / f"x_{rank}"))
    folders = [str(tmp_path / f"x_{r}") for r in (10, 2)]
    assert shards.merge_ranks(spark, folders, str(tmp_path / "all")) == 10
    merged = shards.read_parquet_with_positions(spark, str(tmp_path / "all"))
    assert [r["r"] for r in merged.orderBy("shard", "row_index").collect()] == [2] * 5 + [10] * 5
    with pytest.raises(ValueError):
        shards.merge_ranks(spark, [], str(tmp_path / "none"))


def test_text_columns(spark):
    df = spark.createDataFrame([(None, "raw", 1), ("text", " ", 2)], "text string, raw_content string, n int")
    of = lambda kind: [r[0] for r in df.select(shards.text_column(df, kind)).collect()]
    assert of("plain") == ["", "text"]
    assert of("redpajama") == ["raw", "text"]
    assert of("passthrough")[0].startswith("{") and of("passthrough")[1] == "text"
    with pytest.raises(ValueError):
        of("other")


def test_adapters(spark):
    df = spark.createDataFrame([("a" * 40, "u"), ("a", "v"), (None, "w")], "raw_content string, url string")
    got = shards.raw_content_document(df, 5).collect()
    assert [r["text"] for r in got] == ["", "a", ""] and got[1]["meta"] == {"url": "v"}
    assert [r["text"] for r in shards.math_document(spark.createDataFrame([("a\nb",), ("a\nb\nc",)], "text string"), 2).collect()] == ["a\nb", ""]


def test_resume(spark):
    todo = spark.createDataFrame([(i,) for i in range(5)], "k int")
    done = spark.createDataFrame([(1, "old"), (1, "old"), (9, "x")], "k int, v string")
    assert sorted(r[0] for r in shards.remaining(todo, done, ["k"]).collect()) == [0, 2, 3, 4]
    both = shards.with_cached(todo, done.distinct(), ["k"], lambda df: df.withColumn("v", F.lit("new")))
    assert sorted(map(tuple, both.collect())) == [(0, "new"), (1, "old"), (2, "new"), (3, "new"), (4, "new")]


def test_settings():
    assert shards.fingerprint({"a": 1, "max_docs": 5}) == shards.fingerprint({"max_docs": 9, "a": 1}) != shards.fingerprint({"a": 2})
    assert shards.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


def test_flat_columns(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'c', named_struct('d', 2)) AS a, 3 AS e")
    assert df.select(*shards.flat_columns(df.schema)).columns == ["a/b", "a/c/d", "e"]


def test_text_files(spark, tmp_path):
    got = shards.write_text_files(spark.createDataFrame([("x", "1", None)], "n string, a string, b string"), str(tmp_path / "o"), "n", ["a", "b"]).collect()
    assert len(got) == 1 and (tmp_path / "o" / "x_a.txt").read_text() == "1" and (tmp_path / "o" / "x_b.txt").read_text() == ""


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "id int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    args = dict(source=str(tmp_path / "in"), key="id", text="text", target=str(tmp_path / "out"), checkpoint=str(tmp_path / "state"))
    long = " ".join(f"w{i}" for i in range(20))
    batch("a", [(1, long), (2, None)])
    schema = spark.read.parquet(args["source"]).schema
    refine.refine_stream(spark, schema=schema, **args).awaitTermination()
    batch("b", [(3, long)])
    refine.refine_stream(spark, schema=schema, **args).awaitTermination()
    got = {r["id"]: r["status"] for r in spark.read.parquet(args["target"]).collect()}
    assert got == {1: "edited", 2: "empty_input", 3: "edited"} and spark.read.parquet(args["target"]).count() == 3
