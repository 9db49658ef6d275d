import random

import pytest
from pyspark.sql import functions as F

from siltmill.functions import text as T
from siltmill.operators import chunking


def plain_chunks(text, size, back=500):
    if not text:
        return []
    if size <= 0:
        return [text]
    out, start = [], 0
    while start < len(text):
        window = text[start : start + size]
        if start + size < len(text):
            tail = max(0, size - back)
            at = window.rfind("\n", tail)
            if at > 0:
                window = window[: at + 1]
        out.append(window)
        start += len(window)
    return out


def texts():
    rng = random.Random(4)
    made = ["", "a", "a😀b" * 400, "x" * 2600, "\n" * 1200]
    made += ["".join(rng.choice("ab \n") if rng.random() < 0.1 else "c" for _ in range(rng.randint(1, 3000))) for _ in range(20)]
    made += ["x" * at + "\n" + "y" * 900 for at in (499, 500, 501, 998, 999, 1000)]
    return made


@pytest.mark.parametrize("size", [1000, 700, 300, 0, -1])
def test_characters(spark, size):
    rows = spark.createDataFrame(list(enumerate(texts())), "i int, text string")
    got = {}
    for r in chunking.chunk_characters(rows, "text", size).orderBy("i", "chunk").collect():
        got.setdefault(r["i"], []).append(r["chunk_text"])
    for i, t in enumerate(texts()):
        assert got.get(i, []) == plain_chunks(t, size)
        assert "".join(got.get(i, [])) == t


def plain_lines(counts, budget):
    done, first, total = [], 0, 0
    for i, n in enumerate(counts):
        if total + n <= budget:
            total += n
            continue
        if i > first:
            done.append((first, i - 1))
        if n > budget:
            done.append((i, i))
            first, total = i + 1, 0
        else:
            first, total = i, n
    if len(counts) > first:
        done.append((first, len(counts) - 1))
    return done


def test_lines(spark):
    rng = random.Random(3)
    cases = [[rng.choice([1, 2, 5, 9, 30]) for _ in range(rng.randint(0, 25))] for _ in range(60)] + [[30], [30, 1], [1, 30], [1, 30, 1], []]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, n array<bigint>")
    for r in rows.select("i", chunking.line_spans(F.col("n"), 10).alias("s")).collect():
        assert [(x["first"], x["last"]) for x in r["s"]] == plain_lines(cases[r["i"]], 10)


def test_labels_grow(spark):
    got = spark.createDataFrame([("\n" * 1001,)], "t string").select(T.labelled_lines(F.col("t")).alias("l")).first()["l"]
    assert (got[0], got[999], got[1000]) == ("[000]", "[999]", "[1000]")


def test_counts_like_python(spark):
    made = ["", "a", "a\n", "a\r\nb", "a b\x0bc\x85d", " x  y ", "\x1ca\x1d", "　", "a\n\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string").select("i", T.line_count(F.col("t")).alias("l"), T.word_count(F.col("t")).alias("w"), T.token_estimate(F.col("t")).alias("k"))
    for r in rows.collect():
        t = made[r["i"]]
        assert (r["l"], r["w"], r["k"]) == (len(t.splitlines()), len(t.split()), max(1, (len(t) + 3) // 4)), repr(t)


def test_gather_keeps_empty_documents(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    parts = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (3, 0, None)], "k int, p int, v string")
    got = {r["k"]: (r["parts"], r["joined"]) for r in chunking.gather_all(docs, parts, ["k"], "p", "v").collect()}
    assert got == {1: (2, "a\nb"), 2: (0, ""), 3: (1, "")}
