import difflib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmill.functions import prompts
from siltmill.functions import text as T
from siltmill.operators import ordering, packing, pairs, sampling, scores


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_prefix_sums_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(1)
    rows = [(rng.choice("abcd"), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, i int, n int").repartition(partitions)
    total, expected = 0, {}
    for s, i, n in sorted(rows):
        expected[i] = total
        total += n
    got = {r["i"]: r["before"] for r in ordering.with_prefix(df, ["s", "i"], F.col("n")).collect()}
    assert got == expected
    assert sorted(r["global_index"] for r in ordering.global_index(df, ["s", "i"]).collect()) == list(range(300))


def test_row_ranges(spark):
    for n in (1, 5, 10, 23):
        df = spark.range(n).select("id", ordering.row_range_shard(F.col("id"), F.lit(n), 4).alias("r"))
        for r in df.collect():
            assert n * r["r"] // 4 <= r["id"] < n * (r["r"] + 1) // 4


def test_caps(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, 5), ("b", 0, 0), ("b", 1, 1)], "s string, i int, n int")
    count = lambda f, m: f(df, ["s", "i"], F.col("n"), m).count()
    assert [count(ordering.cap_prefix, m) for m in (4, 5, 9, 10, 11)] == [0, 1, 1, 3, 4]
    assert [count(ordering.budget_prefix, m) for m in (1, 5, 6, 10, 11)] == [1, 1, 2, 2, 4]


def test_keep_mask_and_dissimilarity(spark):
    rng = random.Random(2)
    made = [("".join(rng.choice("abc \n") for _ in range(rng.randint(0, 40))), "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 40)))) for _ in range(40)] + [("", ""), ("abc", "abc"), ("", "x"), ("x", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(made)], "i int, a string, b string")
    masks = {r["i"]: r["mask"] for r in pairs.keep_masks(df, "i", "a", "b").collect()}
    diffs = {r["i"]: r["d"] for r in df.select("i", pairs.dissimilarity(F.col("a"), F.col("b")).alias("d")).collect()}
    for i, (a, b) in enumerate(made):
        assert len(masks[i]) == len(a)
        kept = "".join(c for c, m in zip(a, masks[i]) if m == "1")
        it = iter(b)
        assert all(c in it for c in kept)
        ratio = difflib.SequenceMatcher(None, a, b).quick_ratio()
        expected = 0 if a == b else len(a) + len(b) if not a or not b else (1 - ratio) * (len(a) + len(b))
        assert math.isclose(diffs[i], expected, abs_tol=1e-9)


def test_token_labels(spark):
    df = spark.createDataFrame([("1101", [0, 2, 1, 3], [2, 4, 1, 9], 4), ("11", [0], [1], 4), ("", [], [], 0)], "m string, s array<int>, e array<int>, n int")
    got = [r[0] for r in df.select(pairs.token_labels("s", "e", "m", "n")).collect()]
    assert got == [[1, 0, -100, -100], [0], []]


def test_dissimilarity_against_brute_force(spark):
    rng = random.Random(6)
    made = ["".join(rng.choice("abé漢🌱 \n") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    rows = [(i, rng.choice(made), rng.choice(made)) for i in range(200)] + [(900, None, "ab"), (901, "", "")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for i, a, b, d in df.select("i", "a", "b", pairs.dissimilarity("a", "b").alias("d")).collect():
        a, b = a or "", b or ""
        assert d == len(a) + len(b) - 2 * sum((Counter(a) & Counter(b)).values())


def test_cumulative_lengths_of_any_size(spark):
    rng = random.Random(7)
    rows = [(n, [rng.randint(0, 9) for _ in range(n)]) for n in (0, 1, 2, 255, 256, 257, 512, 1000)]
    for n, x, c in spark.createDataFrame(rows, "n int, x array<bigint>").select("n", "x", packing.cumulative_lengths(F.col("x")).alias("c")).collect():
        assert c == [sum(x[:i]) for i in range(n + 1)]


def test_assignment_and_sequences_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        x = np.array([[rng.choice([0, 0.5, 1, rng.random()]) for _ in range(m)] for _ in range(n)])
        got = scores.best_assignment(x)
        y = x if n <= m else x.T
        assert len(got) == min(n, m) and sum(x[i, j] for i, j in got) == pytest.approx(max(sum(y[i, p[i]] for i in range(len(y))) for p in itertools.permutations(range(y.shape[1]), len(y))))
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        far = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        long = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            far[i + 1][j + 1] = min(far[i][j + 1] + 1, far[i + 1][j] + 1, far[i][j] + (a[i] != b[j]))
            long[i + 1][j + 1] = long[i][j] + 1 if a[i] == b[j] else max(long[i][j + 1], long[i + 1][j])
        assert (scores.edit_distance(a, b), scores.common_subsequence(a, b), len(scores.union_of_subsequences(a, [b]))) == (far[-1][-1], long[-1][-1], long[-1][-1])
    many = np.random.default_rng(1).random((25, 30))
    assert len(scores.best_assignment(many)) == 25  # where trying all subsets would not end


def test_reading_scores():
    score = scores.spans_score
    assert score(["The 7 dogs"], ["7 dogs"]) == (1.0, 1.0)
    assert score(["7 dogs"], ["8 dogs"]) == (0.0, 0.0)  # another number
    assert score(["7.0"], ["7"]) == (1.0, 1.0)
    assert score(["red house", "blue door"], ["blue door"]) == (0.0, 0.5)
    assert score(["red house", "blue door"], ["blue door", "a red house"]) == (1.0, 1.0)
    assert score([], []) == (1.0, 0.0) and score(["x"], []) == (0.0, 0.0)


def test_summary_f1(spark):
    df = spark.createDataFrame([("a b c\nd e", "a c\ne d", 1), ("a b", "a b", 2), ("", "", 3), (None, "x", 4)], "g string, p string, i int")
    got = {i: f for f, i in df.select(scores.summary_f1("g", "p"), "i").collect()}
    assert got == {1: pytest.approx(2 * 3 / 9), 2: 1.0, 3: 0.0, 4: 0.0}


def test_causal_example(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<int>, t array<int>")
    ids, labels = pairs.causal_example(F.col("p"), F.col("t"), 4)
    assert tuple(df.select(ids, labels).first()) == ([2, 3, 4, 5], [-100, -100, 4, 5])


def test_packing_conserves_tokens(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, [i * 100 + j for j in range(rng.randint(0, 30))]) for i in range(50)]
    df = spark.createDataFrame(rows, "s string, i int, ids array<int>")
    flat = [x for r in sorted(rows) for x in r[2]]
    got = packing.pack_blocks(df, ["s", "i"], "ids", 16).orderBy("block").collect()
    assert [x for r in got for x in r["block_ids"]] == flat[: len(flat) // 16 * 16]


def test_lengths(spark):
    df = spark.createDataFrame([([3, 1, 2, 1, 1],), ([1, 1],), ([],)], "n array<bigint>")
    c = packing.cumulative_lengths(F.col("n"))
    got = df.select(c, packing.lengths_of(c), packing.position_ids(F.col("n")), packing.without_tail(F.col("n"))).collect()
    assert tuple(got[0]) == ([0, 3, 4, 6, 7, 8], [3, 1, 2, 1, 1], [0, 1, 2, 0, 0, 1, 0, 0], [3, 1, 2])
    assert tuple(got[1])[3] == [] and tuple(got[2]) == ([0], [], [], [])


def test_balance(spark):
    rows = [(0, i, n) for i, n in enumerate([200, 400, 600, 800, 1000] * 8)]
    got = packing.balance(spark.createDataFrame(rows, "g int, k int, n int"), "g", "k", "n", 8).collect()
    sums = [0] * 8
    for r in got:
        sums[r["bin"]] += rows[r["k"]][2] ** 2
    assert len(set(sums)) == 1


def test_packed_files(spark, tmp_path):
    rows = [([i, i + 1, i + 2, 65_000],) for i in range(10)]
    files = packing.write_packed(spark.createDataFrame(rows, "ids array<int>").repartition(3), "ids", str(tmp_path), 4).collect()
    assert sum(r["blocks"] for r in files) == 10
    assert sorted(r["ids"] for r in packing.read_packed(spark, str(tmp_path)).collect()) == sorted(r[0] for r in rows)


def test_samples(spark):
    df = spark.range(1000)
    held = sampling.hold_out(df, ["id"], 1, 30)
    assert held.where("is_held").count() == 30
    assert {r["id"] for r in held.where("is_held").collect()} == {r["id"] for r in sampling.hold_out(df.repartition(7), ["id"], 1, 30).where("is_held").collect()}
    draws = {r["d"]: r["n"] for r in df.groupBy(sampling.mixture_draw({"a": 3, "b": 1}, 2, F.col("id")).alias("d")).agg(F.count("*").alias("n")).collect()}
    assert 680 < draws["a"] < 820
    pool = sampling.balanced_pool(df.withColumn("label", F.when(F.col("id") < 900, "x").otherwise("y")), "id", "label", 3, 6).collect()
    assert [r["label"] for r in pool] == ["x", "y"] * 3


def test_choice_scores(spark):
    df = spark.createDataFrame([([10.0, 20.0], [" hell", "world"], [[1, 2, 3], [4, 5]], [5.0, 8.0], [1])], "lp array<double>, c array<string>, t array<array<int>>, u array<double>, g array<int>")
    r = df.select(scores.by_characters(F.col("lp"), F.col("c")), scores.by_characters(F.col("lp"), F.col("c"), True), scores.by_tokens(F.col("lp"), F.col("t")), scores.by_prior(F.col("lp"), F.col("u")), scores.reciprocal_rank(F.col("lp"), F.col("g"))).first()
    assert r[0] == [2.0, 4.0] and r[1] == [2.5, 4.0] and np.allclose(r[2], [10 / 3, 10]) and r[3] == [5.0, 12.0] and r[4] == 1.0


def test_ties(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0], [1], ["b", "a", "a", "b"])], "lp array<double>, g array<int>, v array<string>")
    r = df.select(scores.best_choice(F.col("lp")), scores.choice_accuracy(F.col("lp"), F.col("g")), scores.reciprocal_rank(F.col("lp"), F.col("g")), scores.recall_at(F.col("lp"), F.col("g"), 1), scores.recall_at(F.col("lp"), F.col("g"), 2), scores.majority(F.col("v"))).first()
    assert tuple(r) == (0, 0, 1.0, 0, 1, "b")


@pytest.mark.parametrize("n,c,k", [(10, 0, 3), (10, 3, 3), (10, 8, 3), (5, 5, 5), (4, 1, 1)])
def test_pass_at_k(spark, n, c, k):
    df = spark.createDataFrame([(n, c)], "n bigint, c bigint")
    got = df.select(scores.pass_at_k(F.col("n"), F.col("c"), k), scores.many_of_k(F.col("n"), F.col("c"), k, 1.0)).first()
    assert math.isclose(got[0], 1 - math.comb(n - c, k) / math.comb(n, k), abs_tol=1e-9)
    assert math.isclose(got[1], math.comb(c, k) / math.comb(n, k), abs_tol=1e-9)


def test_text_scores(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat", ["a b", "c"], ["c", "b a"])], "g string, p string, x array<string>, y array<string>")
    r = df.select(scores.bag_f1(F.col("g"), F.col("p")), scores.rouge_n(F.col("g"), F.col("p"), 1), scores.longest_common_f1("g", "p"), scores.word_edits("g", "p"), scores.common_prefix(F.col("g"), F.col("p")), scores.assigned_f1("x", "y")).first()
    assert np.allclose(list(map(float, r)), [2 * 3 / 8, 2 * 3 / 9, 2 * 3 / 9, 3, 3, 1.0])


@pytest.mark.parametrize("a,b,equal", [("3", "3.0001", True), ("50%", "0.5", True), ("50", "0.5", True), ("1,000", "1000", True), ("3", "4", False), ("x", " X ", True), ("", "0", False)])
def test_number_equality(spark, a, b, equal):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(scores.numbers_equal(F.col("a"), F.col("b"))).first()[0] is equal


def test_final_answer(spark):
    made = {r"so \boxed{\frac{1}{2}} and \boxed{7}": "7", r"\boxed{a{b}c}": "a{b}c", "The answer is: 12 apples. Yes": "12 apples", "first 3 then 1,204.5 left": "1204.5", "none": ""}
    got = spark.createDataFrame([(k,) for k in made], "t string").select("t", scores.final_answer(F.col("t")).alias("a")).collect()
    assert {r["t"]: r["a"] for r in got} == made


def test_small_texts(spark):
    df = spark.createDataFrame([("<think>a</think>b<think>c</think>", " [title] x [b]  y", "#### 1,200", "B")], "a string, b string, c string, d string")
    r = df.select(T.without_tags(F.col("a"), ("<think>", "</think>")), T.without_brackets(F.col("b")), T.final_number(F.col("c")), prompts.gold_from_letter(F.col("d"))).first()
    assert tuple(r) == ("b", ".  x  y".replace("  x", " x"), "1200", 1)


def test_bootstrap_is_near_the_formula(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("s"))
    got = scores.bootstrap_error(df, ["id"], "s", 200, 1).first()
    assert abs(got["stderr"] - 0.5 / math.sqrt(2000)) < 0.003
