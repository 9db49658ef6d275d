import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltmill.functions import text as T
from siltmill.operators import extraction, ordering


@pytest.mark.parametrize(
    "text,plain",
    [("$\\dfrac12$", "\\frac{1}{2}"), ("1/2", "\\frac{1}{2}"), ("x = 5", "5"), ("5\\text{ cm}^2", "5"), ("\\sqrt3", "\\sqrt{3}"), (".5", "0.5"), ("3.00", "3"), ("\\left( 1, 2 \\right)", "(1,2)"), ("90^\\circ", "90"), ("50\\%", "50"), ("", "")],
)
def test_latex(text, plain):
    assert extraction.plain_latex(text) == plain


def test_transcripts(spark):
    t = "a\n```python\nprint(1)\n```\n```output\n1\n```\nb\n```output\n```\n"
    r = spark.createDataFrame([(t,)], "t string").select(extraction.output_blocks(F.col("t")), extraction.code_blocks(F.col("t"))).first()
    assert r[0] == ["1", ""] and r[1] == ["print(1)"]


def test_ground_truth(spark):
    df = spark.createDataFrame([("so 7\n#### 1,234", "(b)", "it is -1,500.5 m")], "h string, o string, n string")
    r = df.select(extraction.ground_truth(F.col("h"), "hashes"), extraction.ground_truth(F.col("o"), "options"), extraction.ground_truth(F.col("n"), "number")).first()
    assert tuple(r) == ("1234", "B", "-1500.5")
    with pytest.raises(ValueError):
        extraction.ground_truth(F.lit(""), "other")


def test_fragments():
    assert extraction.greedy_fragments("a b c d e".split(), "b c x d e a".split()) == [2, 2, 1]
    assert extraction.greedy_fragments([], ["a"]) == [] and extraction.greedy_fragments(["a"], []) == []


def test_extractive_statistics(spark):
    df = spark.createDataFrame([(1, "a b c d", "b c"), (2, "a", ""), (3, None, "x")], "k int, s string, t string")
    got = {r["k"]: (r["coverage"], r["density"], r["compression"]) for r in extraction.extractive_statistics(df, "k", "s", "t").collect()}
    assert got == {1: (1.0, 2.0, 2.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_corpus_bleu(spark):
    pairs = [("the cat sat on the mat", "the cat sat on mat"), ("a b c d", "a b c d")]
    hits, totals, g, p = Counter(), Counter(), 0, 0
    for a, b in pairs:
        x, y = a.split(), b.split()
        g, p = g + len(x), p + len(y)
        for n in (1, 2):
            u, v = Counter(zip(*(x[i:] for i in range(n)))), Counter(zip(*(y[i:] for i in range(n))))
            hits[n] += sum((u & v).values())
            totals[n] += sum(v.values())
    expected = 100 * min(1, math.exp(1 - g / p)) * math.sqrt(hits[1] / totals[1] * hits[2] / totals[2])
    got = extraction.corpus_bleu(spark.createDataFrame(pairs, "g string, p string"), "g", "p", 2).first()
    assert math.isclose(got["bleu"], expected)
    assert extraction.corpus_bleu(spark.createDataFrame([("a", "b")], "g string, p string"), "g", "p").first()["bleu"] == 0


def test_class_f1(spark):
    rows = [(0, 0)] * 3 + [(1, 0)] + [(1, 1)] * 2 + [(2, 1)]
    got = extraction.class_f1(spark.createDataFrame(rows, "t int, g int"), "t", "g").first()
    each = {0: 6 / 7, 1: 4 / 6, 2: 0.0}
    assert math.isclose(got["macro"], sum(each.values()) / 3) and math.isclose(got["weighted"], (3 * each[0] + 3 * each[1]) / 7) and math.isclose(got["micro"], 5 / 7)


def test_numbered_text(spark):
    df = spark.createDataFrame([(["aaaa", "bbbbbbbb", "cccc"], [1, 2, 1])], "l array<string>, t array<bigint>")
    of = lambda n: df.select(extraction.numbered_text(F.col("l"), F.col("t"), n)).first()[0]
    assert (of(1), of(2), of(3), of(9)) == ("aaaa", "aaaa\nbbbb", "aaaa\nbbbbbbbb", "aaaa\nbbbbbbbb\ncccc")


def test_pattern_priority(spark):
    df = spark.createDataFrame([("a 1 b 2",), ("x=3 y=4 5",), ("none",)], "t string")
    assert [r[0] for r in df.select(extraction.first_match(F.col("t"), [r"y=(\d)", r"(\d)"])).collect()] == ["2", "4", ""]


def test_first_of_each_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z")], "k string, n int, v string")
    assert sorted(map(tuple, ordering.first_by(df, ["k"], [F.col("n")]).collect())) == [("a", 1, "y"), ("b", None, "z")]


def test_chat_content(spark):
    made = {None: "", "plain": "plain", '["a", "b"]': "ab", '[{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]': "ab", "[]": ""}
    df = spark.createDataFrame([(k,) for k in made], "c string")
    assert {r[0]: r[1] for r in df.select("c", T.joined_chat_content(F.col("c"))).collect()} == made


def test_plain_sentences(spark):
    made = {"it 's 1 @,@ 000 ( one ) . Next : \" a b \" , N x @-@ y": "it's 1,000 (one). Next: \"a b\", 1 x-y", "= = Head = = \n text": "== Head ==\ntext", "boys ' [ a ] { b }": "boys' [a] {b}", "": ""}
    df = spark.createDataFrame([(k,) for k in made], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.plain_sentences(F.col("t"))).collect()} == made
