import random
import time

import pytest
from pyspark.sql import functions as F

from siltmill.operators import models, programs

TEXT = "\n".join(f"line {i} with quite a few words in it" for i in range(6))

# program, errors, lines left
CASES = [
    ("keep_all()", 0, 6),
    ("", 0, 6),
    ("remove_lines(line_start=0, line_end=1)", 0, 4),
    ("remove_lines(line_start=4, line_end=9)", 1, 4),
    ("remove_lines(line_start=6, line_end=9)", 1, 6),
    ("remove_lines(line_start=3, line_end=1)", 0, 6),
    ("remove_lines(line_start=9, line_end=1)", 1, 6),
    ("remove_lines(line_start=-3, line_end=0)", 0, 5),
    ("remove_lines(line_start= +1 , line_end=1_0)", 1, 1),
    ("remove_lines line_start=1, line_end=2", 1, 6),
    ("remove_lines(line_start=1, line_end=23", 1, 4),
    ("remove_lines(line_start=x, line_end=2)", 1, 6),
    ("remove_lines(1, 2)", 1, 6),
    ("remove_lines(all=True)", 0, 0),
    ("remove_lines(line_start=9, line_end=9)\nremove_lines(line_start=10, line_end=12)", 1, 6),
    ("remove_lines(line_start=8, line_end=8)\nremove_lines(line_start=12, line_end=12)", 2, 6),
    (" remove_lines(line_start=0, line_end=0)", 0, 5),
    ("keep_all()\n remove_lines(line_start=0, line_end=0)", 0, 6),
    ("REMOVE_LINES(line_start=0, line_end=0)", 0, 6),
    ('normalize(source_str="a,b")', 1, 6),
    ('normalize(source_str="a", target_str="b", more="c")', 0, 6),
    ("normalize", 1, 6),
]


@pytest.fixture(scope="module")
def executed(spark):
    rows = spark.createDataFrame([(i, TEXT, p) for i, (p, _, _) in enumerate(CASES)], "i int, text string, program string")
    return {r["i"]: r for r in programs.execute(rows, "text", "program").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_execution(executed, i):
    program, errors, left = CASES[i]
    got = executed[i]
    assert got["errors"] == errors, program
    assert got["removed_lines"] == 6 - left, program


def run(spark, text, program):
    return programs.accept(programs.execute(spark.createDataFrame([(text, program)], "text string, program string"), "text", "program"), "text").first()


def test_normalize(spark):
    assert run(spark, "aXbXc", 'normalize(source_str="X")')["edited"] == "abc"
    assert run(spark, "aXbXc", 'normalize(source_str="X", target_str="--")')["edited"] == "a--b--c"
    assert run(spark, "a b", 'normalize(source_str=" ", target_str="-")')["edited"] == "a b"
    assert run(spark, "a b", 'normalize(source_str=" ")')["edited"] == "ab"
    assert run(spark, 'say "x"', 'normalize(source_str=""x"", target_str="y")')["edited"] == 'say "y"'


def words(n):
    return " ".join(f"w{i}" for i in range(n))


def test_acceptance(spark):
    assert run(spark, words(11), "keep_all()")["status"] == "edited"
    assert run(spark, words(10), "keep_all()")["status"] == "too_short"
    bad = "remove_lines(a)\nremove_lines(b)"
    assert run(spark, words(11), bad)["status"] == "original"
    assert run(spark, words(10), bad)["status"] == "too_short"
    assert run(spark, words(10) + "\n" + words(190), "remove_lines(line_start=1, line_end=1)")["status"] == "dropped"
    for text in (None, "", " \n "):
        got = run(spark, text, "keep_all()")
        assert (got["status"], got["refined"]) == ("empty_input", "")


def test_merging_does_not_depend_on_order(spark):
    a = run(spark, TEXT, "remove_lines(x=3, y=4)\nremove_lines(x=0, y=1)\nremove_lines(x=2, y=2)")
    assert [tuple(r) for r in a["merged"]] == [(0, 4)]


def test_document_program(spark):
    rows = spark.createDataFrame([("t", "keep(no drop)"), ("t", "Drop"), (None, "keep"), ("t", None)], "t string, p string")
    assert [r[0] for r in rows.select(programs.document_program(F.col("t"), F.col("p"))).collect()] == ["", "t", "", "t"]


def test_model_failures_become_rows(spark):
    class Broken:
        def programs(self, prompts):
            raise RuntimeError("no device")

    got = models.generate(spark.createDataFrame([(1, "a"), (2, None)], "k int, p string"), ["k"], "p", Broken).collect()
    assert len(got) == 2 and all(r["program"] is None and "no device" in r["error"] for r in got)


def test_rule_program(spark):
    text = "same\nother\nsame\nhttps://a.example/b\n\n\ntwo  blanks"
    rows = models.with_rule_program(spark.createDataFrame([(text,)], "text string"), "text", "program")
    got = programs.execute(rows, "text", "program").first()
    assert got["edited"] == "same\nother\n\n\ntwo blanks"


def test_ranges_of_every_kind_against_brute_force(spark):
    """Overlapping, touching, reversed, negative and far ranges; more of them than one piece holds."""
    rng = random.Random(12)
    cases = []
    for size in (0, 1, 5, 40, 300, 900):
        for _ in range(6):
            text = "\n".join(f"line {i}" for i in range(rng.randint(1, 60)))
            pairs = [(a, a + rng.choice([0, 0, 1, 5, -2, 70])) for a in (rng.randint(-3, 70) for _ in range(size))]
            cases.append((len(cases), text, "\n".join(f"remove_lines(line_start={a}, line_end={b})" for a, b in pairs), pairs))
    df = spark.createDataFrame([c[:3] for c in cases], "id int, text string, program string")
    got = {r["id"]: r for r in programs.execute(df, "text", "program").collect()}
    for i, text, _, pairs in cases:
        own = text.split("\n")
        gone = {x for a, b in pairs for x in range(a, b + 1)}
        kept = [x for n, x in enumerate(own) if n not in gone]
        merged = []
        for a, b in sorted(pairs, key=lambda p: p[0]):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        assert got[i]["edited"] == "\n".join(kept) and got[i]["removed_lines"] == len(own) - len(kept)
        assert [[m["first"], m["last"]] for m in got[i]["merged"]] == merged
        assert got[i]["errors"] == sum(a >= len(own) or b >= len(own) for a, b in merged)


def test_a_book_of_many_lines(spark):
    """50,000 lines, half of them to be removed one by one, in seconds."""
    text = "\n".join(f"line number {i // 2} of the book" if i % 2 else f"other words {i} here" for i in range(25_000)) + "\n" + "\n".join("again" if i % 2 else f"fresh {i}" for i in range(25_000))
    rows = models.with_rule_program(spark.createDataFrame([(1, text)], "id int, text string"), "text", "program")
    began = time.monotonic()
    got = programs.accept(programs.execute(rows, "text", "program"), "text").first()
    assert time.monotonic() - began < 20
    assert got["removed_lines"] == 12_499 and got["errors"] == 0 and got["status"] == "edited"
