"""Queries that have no SQL, against plain Python over the same tables."""

import difflib
import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltmill.operators import extraction, scores
from siltmill.plans.all_queries import ORACLE_SQL, QUERIES
from siltmill.plans.evaluation import written
from siltmill.plans.refining import documents, refined_chunks

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TESTED_HERE = {"sequence_scores", "extractive_statistics", "latex_answers", "keep_mask", "inline_diff", "mask_pairs", "reading_comprehension"}


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def test_every_query_is_compared():
    assert set(QUERIES) - set(ORACLE_SQL) == TESTED_HERE


@pytest.fixture(scope="module")
def chunks(spark):
    return {r["chunk_id"]: r for r in refined_chunks(spark, FOLDER).select("chunk_id", "chunk_body", "edited", "status").collect()}


def mask_of(a, b):
    mask = ["0"] * len(a)
    for i, _, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        mask[i : i + n] = "1" * n
    return "".join(mask)


def test_keep_mask(spark, chunks):
    got = {r["chunk_id"]: (r["chars"], r["kept"], r["mask"]) for r in QUERIES["keep_mask"](spark, FOLDER).collect()}
    assert got == {k: (len(m), m.count("1"), md5(m)) for k, m in ((k, mask_of(r["chunk_body"], r["edited"])) for k, r in chunks.items())}


def test_inline_diff(spark, chunks):
    steps = Counter()
    for r in chunks.values():
        if r["status"] == "edited":
            steps.update(t for t, *_ in difflib.SequenceMatcher(None, r["chunk_body"], r["edited"], autojunk=False).get_opcodes())
    assert {r["tag"]: r["steps"] for r in QUERIES["inline_diff"](spark, FOLDER).collect()} == steps


def test_extractive_statistics(spark, chunks):
    got = {r["chunk_id"]: (r["coverage"], r["density"], r["compression"]) for r in QUERIES["extractive_statistics"](spark, FOLDER).collect()}
    assert set(got) == set(chunks)
    for k, r in chunks.items():
        a, b = r["chunk_body"].split(), r["edited"].split()
        runs, j = [], 0
        while j < len(b):
            best = 0
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, n)
            runs += [best] * (best > 0)
            j += max(best, 1)
        expected = (sum(runs) / len(b), sum(n * n for n in runs) / len(b), len(a) / len(b)) if b else (0, 0, 0)
        assert got[k] == pytest.approx(expected, abs=1e-5)


def test_latex_answers(spark):
    answers = {r["doc_id"]: r["a"] for r in documents(spark, FOLDER).select("doc_id", scores.final_answer(F.col("text")).alias("a")).collect()}
    got = {r["doc_id"]: r["answer"] for r in QUERIES["latex_answers"](spark, FOLDER).collect()}
    assert got == {k: md5(extraction.plain_latex(a) if a else "") for k, a in answers.items()}


@pytest.mark.parametrize(
    "raw,plain",
    [
        (r"\dfrac12", r"\frac{1}{2}"), (r"\tfrac{a}{b}", r"\frac{a}{b}"), ("3/4", r"\frac{3}{4}"), (r"\sqrt3", r"\sqrt{3}"), (r"90^\circ", "90"), (r"90^{\circ}", "90"), (r"5\text{ cm}^2", "5"), ("x = 7", "7"), (".5", "0.5"), ("2.00", "2"), (r"\left( 1, 2 \right)", "(1,2)"),
        (r"\$12", "12"), (r"50\%", "50"), (r"1\,000", "1000"), (r"\text{yes}", "yes"), ("$4$.", "4"),
    ],
)
def test_plain_latex(raw, plain):
    assert extraction.plain_latex(raw) == plain


def test_latex_inside_the_jvm(spark):
    rng = random.Random(4)
    pieces = [r"\dfrac", r"\tfrac12", r"\frac{1}{2}", "3/4", "-3/4", r"\sqrt3", r"\sqrt{2}", r"^\circ", r"\text{ cm}^2", r"\text{m}", r"\mbox{yes}", "x = ", "7", ".5", "2.00", " ", r"\left(", r"\right)", r"\$", r"\%", "%", "$", ".", ",", "\u00a0", "{a}", r"\,", "é"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(made)), "i int, t string").select("i", extraction.latex_normal("t").alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: extraction.plain_latex(t) for i, t in enumerate(made)}


def f1(a, b):
    x, y = set(a.lower().split()), set(b.lower().split())
    return 2 * len(x & y) / (len(x) + len(y)) if x & y else 0.0


def best(gold, found):
    """All assignments, one after another."""
    if len(gold) > len(found):
        gold, found = found, gold
    if not gold:
        return 0.0
    return max(f1(gold[0], p) + best(gold[1:], found[:j] + found[j + 1 :]) for j, p in enumerate(found))


@pytest.fixture(scope="module")
def answered(spark):
    return {(r["id"], r["model"]): (r["golds"], [t or "" for t in r["text"]]) for r in written(spark, FOLDER).where("size(golds) > 0").select("id", "model", "golds", "text").collect()}


def common(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, v in enumerate(x):
        for j, w in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if v == w else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, v in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, w in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (v != w))
    return row[-1]


def test_sequence_scores(spark, answered):
    got = {(r["id"], r["model"]): (r["rouge_l"], r["edits"], r["assigned_f1"]) for r in QUERIES["sequence_scores"](spark, FOLDER).collect()}
    assert set(got) == set(answered)
    for k, (golds, texts) in answered.items():
        x, y = golds[0].split(), texts[0].split()
        n = common(x, y)
        assert got[k] == pytest.approx((2 * n / (len(x) + len(y)) if n else 0, edits(x, y), best(golds, texts) / max(len(golds), len(texts))), abs=1e-5)


def test_reading_comprehension(spark, answered):
    got = {(r["id"], r["model"]): r for r in QUERIES["reading_comprehension"](spark, FOLDER).collect()}
    assert set(got) == set(answered)
    for k, (golds, texts) in answered.items():
        x, y = golds[0].split(), texts[0].split()
        assert got[k]["edit_similarity"] == pytest.approx(1 - edits(x, y) / max(len(x), len(y)) if x or y else 1, abs=1e-5)
        assert got[k]["exact"] in (0, 1) and 0 <= got[k]["f1"] <= 1 and (got[k]["exact"] == 0 or got[k]["f1"] == 1)
        if "\n" not in golds[0] + texts[0] and len(set(x)) == len(x) and len(set(y)) == len(y):
            n = common(x, y)
            assert got[k]["rouge_lsum"] == pytest.approx(2 * n / (len(x) + len(y)) if n else 0, abs=1e-5)
        if golds[0].strip() == texts[0].strip():
            assert got[k]["equal"]


def test_mask_pairs(spark):
    rows = spark.read.parquet(f"{FOLDER}/denoise_dataset.parquet").collect()
    first: dict = {}
    for r in sorted(rows, key=lambda r: r["chunk_id"]):
        first.setdefault((r["source_parquet"], r["source_row_index"], r["chunk_index"]), r["chunk_body"] or "")
    bodies: dict = {}
    for (s, i, n), body in sorted(first.items()):
        bodies.setdefault((s, i), []).append(body)
    outputs: dict = {}
    for r in spark.read.parquet(f"{FOLDER}/code_output.parquet").collect():
        k = (r["source_parquet"], r["source_row_index"])
        outputs[k] = max(outputs.get(k, ""), r["programs_delimited"] or "", key=lambda x: (len(x), x))
    separator = "\n\n### OPENROUTER_CHUNK_PROGRAM ###\n\n"
    expected = {k: (md5(x[0]), md5(mask_of(x[0], outputs[k].replace(separator, "")))) for k, x in bodies.items() if len(x) == 1 and k in outputs}
    got = {(r["source_parquet"], r["source_row_index"]): (r["text"], r["target"]) for r in QUERIES["mask_pairs"](spark, FOLDER).collect()}
    assert got == expected
