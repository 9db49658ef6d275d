"""Queries over whole inputs, against brute force on small tables."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from siltmill.operators import scores
from siltmill.plans.all_queries import QUERIES


def md5(x: str) -> str:
    return hashlib.md5(x.encode()).hexdigest()


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_token_labels_of_every_length(spark, tmp_path):
    texts = [None, "", "abcd", "abcde", "é" * 4_999, "xyé z" * 1_000, "ab c€" * 4_001 + "abc"]
    d = written(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["kept"], r["tokens"], r["rebuilt"]) for r in QUERIES["token_labels"](spark, d).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        starts = range(0, len(text) // 5 * 5, 5)
        kept = sum(all(x % 11 != 3 for x in range(s, s + 5)) for s in starts)
        assert got.pop(i) == (kept, len(starts), md5("".join(text[s : s + 5] for s in starts if s % 3)))
    assert not got


def test_pass_at_k_counts_every_event(spark, tmp_path):
    sizes = {1: (2, 1), 2: (3, 1), 3: (25, 24), 4: (99, 3), 5: (400, 150), 6: (30, 0)}
    rows = [(u, "purchase" if i < c else "view") for u, (n, c) in sizes.items() for i in range(n)]
    d = written(spark, tmp_path, "events", rows, "user_id bigint, event_type string")
    got = {r["user_id"]: (r["pass_3"], r["half_of_3"]) for r in QUERIES["pass_at_k"](spark, d).collect()}
    assert sorted(got) == [2, 3, 4, 5, 6]
    for u, found in got.items():
        n, c = sizes[u]
        chance = lambda i: math.comb(c, i) * math.comb(n - c, 3 - i) / math.comb(n, 3)
        assert found == pytest.approx((1 - chance(0), chance(2) + chance(3)), abs=1e-6)


def test_many_of_k_of_large_counts(spark):
    df = spark.createDataFrame([(n, c) for n in (10, 171, 5_000) for c in (0, 2, 7, n // 2, n)], "n bigint, c bigint")
    for n, c, tail in df.select("n", "c", scores.many_of_k(F.col("n"), F.col("c"), 10, 0.5)).collect():
        assert tail == pytest.approx(sum(math.comb(c, i) * math.comb(n - c, 10 - i) for i in range(5, 11)) / math.comb(n, 10), abs=1e-9)


def test_causal_labels_keep_the_end(spark, tmp_path):
    texts = [None, "", "a bb ccc", " ".join("x" * (1 + i % 7) for i in range(12)), " ".join("x" * (1 + i % 9) for i in range(45)), " ".join("x" * (1 + i * i % 31) for i in range(3_000))]
    d = written(spark, tmp_path, "documents", [(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    got = {r["doc_id"]: (r["ids"], r["supervised"], r["padded"]) for r in QUERIES["causal_labels"](spark, d).collect()}
    for i, text in enumerate(texts):
        ids = [len(w) for w in (text or "").split()]
        last = ids[-40:]
        supervised = max(min(len(ids) - 10, 40), 0)
        assert got.pop(i) == (md5(",".join(map(str, last))), supervised, md5(",".join(map(str, last + [0] * (48 - len(last))))))
    assert not got


def test_pack_batch_takes_whole_documents(spark, tmp_path):
    texts = [" ".join("x" * (1 + (i + j) % 9) for j in range(n)) for i, n in enumerate((20, 0, 13, 40, 5, 1, 2, 3, 12, 14, 30))]
    d = written(spark, tmp_path, "documents", [(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    got = {r["grp"]: (r["ids"], r["size"]) for r in QUERIES["pack_batch"](spark, d).collect()}
    for grp in (0, 1):
        ids = []
        for i, text in enumerate(texts[grp * 8 : grp * 8 + 8]):
            ids += [99] * (i > 0) + [len(w) for w in text.split()]
        assert got.pop(grp) == (md5(",".join(map(str, ids[:60]))), min(len(ids), 60))
    assert not got
