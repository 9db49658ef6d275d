"""Normalisers, templates, pools, sinks and pipelines on small cases."""

import importlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from siltmill.functions import prompts
from siltmill.functions import text as T
from siltmill.operators import extraction, packing, pairs, pipelines, sampling, scores
from siltmill.sources import shards


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], kinds).select(column).first()[0]


def test_tags(spark):
    tags = lambda t, *p: one(spark, T.without_tags(F.col("t"), *p), t=t)
    think = ("<think>", "</think>")
    assert tags("<think> a </think> b", think) == " b"
    assert tags("</think>x<think>1\n</think>y<think>2</think>z", think) == "</think>xyz"
    assert tags("a<think>b", think) == "a<think>b" and tags("a</think>b", think) == "a</think>b"
    assert tags("<r>1</r>a<think>2</think>", ("<r>", "</r>"), think) == "a"


def test_normalisers(spark):
    assert one(spark, T.spaced_stops(F.col("t")), t="a . b . c.") == "a.\nb.\nc."
    assert [one(spark, T.without_braces(F.col("t"), s), t=" {a} ") for s in (False, True)] == [" {a} ", "a"]
    assert one(spark, T.without_braces(F.col("t")), t="{{a}}") == "{a}" and one(spark, T.without_braces(F.col("t")), t="a") == "a"
    normal = lambda t, lang: one(spark, T.answer_normal(F.col("t"), lang), t=t)
    assert normal("The cat, a dog… and «an» owl!", "en") == "the cat dog and owl"
    assert normal("la casa y unos gatos", "es") == "casa y gatos" and normal("das Haus", "de") == "haus" and normal("the x", "xx") == "the x"
    assert one(spark, T.token_budget(F.col("n"), 3.5), n=100) == 28
    with pytest.raises(ValueError, match="above 0"):
        T.token_budget(F.lit(1), 0)


def test_output_text(spark):
    df = spark.createDataFrame([("a", "b", ["p"]), (" ", "", ["p", "q"]), (None, "b", None), (" ", " ", None)], "text string, programs_delimited string, programs array<string>")
    got = [r[0] for r in df.select(T.output_text(df)).collect()]
    assert got[:3] == ["a", "p\n\nq", "b"] and json.loads(got[3])["text"] == " "
    assert [r[0] for r in df.select(T.output_text(df, is_code=True)).collect()][:3] == ["p", "p\n\nq", "b"]


def test_templates(spark):
    both = lambda pair, **v: (one(spark, pair[0], **v), one(spark, pair[1], **v))
    q, c = F.col("q"), F.col("c")
    assert both(prompts.continuation(q, c), q="He ran. ", c=["then slept", "Ate"]) == ("He ran.", [" Then slept", " Ate"])
    assert both(prompts.continuation(q, c), q="He ran and", c=["Then slept"]) == ("He ran and", [" then slept"])
    assert both(prompts.cause_or_effect(q, F.lit("effect"), c), q="It rained.", c=["We got wet."]) == ("It rained therefore", [" we got wet."])
    assert both(prompts.blank_filled(q, c), q="The _ barked.", c=["dog"]) == ("The", [" dog barked."])
    assert both(prompts.blank_filled(q, c), q="No gap", c=["dog"]) == ("No gap", [" dog"])
    assert both(prompts.entailment(q, F.lit("It is wet.")), q="It rained.") == ("It rained, right?", [" Yes, it is wet.", " Also, it is wet.", " No, it is wet."])
    assert one(spark, prompts.reading_question(F.lit(" "), q), q="Why?") == "Question: Why?\nAnswer:"
    assert both(prompts.yes_no(F.lit("Text."), q), q="So?") == ("Text.\nQuestion: So?\nAnswer:", [" Yes", " No"])
    assert one(spark, prompts.sentence_middle(q), q="Über") == "über"


def test_question_forms(spark):
    ask = lambda form, **row: one(spark, extraction.question({k: F.col(k) for k in row}, form), **row)
    assert ask("stopped_body", body="Two cats ", question=" How many?") == "Two cats. How many?"
    assert ask("option_string", question="Q?", options="A) one B) two").endswith("\n(A) one (B) two")
    assert ask("option_list", question="how?", options="a ) 1 , b ) 2").endswith("answer.\n(A) 1, (B) 2") and ask("option_list", question="how?", options="['a ) 1', 'b ) 2']").startswith("How?")
    assert ask("option_list", question="how?", options="['a ) 1', 'b ) 2']").endswith("(A) 1, (B) 2")
    assert ask("table", title="", table="a|b", question="Q?", options=["x"]) == 'Read the following table and answer a question:\na|b\nQ? Please select from the following options: ["x"]'
    assert ask("first", a=" ", b="x ", c="y") == "x"
    closed = lambda t: one(spark, extraction.closed_question(F.lit("Q?"), F.col("t")), t=t)
    assert [closed(t) for t in ("TRUE", "no", "7")] == ["Q? (True or False)", "Q? (Yes or No)", "Q?"]
    truth = lambda form, a: one(spark, extraction.ground_truth(F.col("a"), form), a=a)
    assert truth("boxed", r"so \boxed{1} or \boxed{\frac{1}{2}}") == r"\frac{1}{2}" and truth("boxed", "none") == ""
    assert (truth("bracketed_number", "1,200 (apples)"), truth("index", "2"), truth("truth", "1")) == ("1200", "C", "True")


def test_pools(spark):
    df = spark.createDataFrame([("t", f"i{k}") for k in range(6)] + [("u", "only")], "task string, id string")
    pool = {r["id"]: r["place"] for r in sampling.sequential_pool(df.where("task = 't'"), ["id"], 2, 2).collect()}
    assert [k for k, _ in sorted(pool.items(), key=lambda x: x[1])] == ["i4", "i5", "i0", "i1", "i2", "i3"]
    got: dict = {}
    for r in sampling.few_shots(df, sampling.sequential_pool(df, ["id"], 2), "task", "id", 2).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["example"]
    assert got["i0"] == {0: "i1", 1: "i2"} and got["i1"] == {0: "i0", 1: "i2"} and got["i5"] == {0: "i0", 1: "i1"} and "only" not in got
    a, b = ([r["id"] for r in sampling.random_pool(df, ["id"], s).orderBy("place").collect()] for s in (1, 2))
    assert sorted(a) == sorted(b) and a != b
    assert sampling.example_split(["test", "dev", "train_small"], ["test"]) == "train_small" and sampling.example_split(["test"], ["test"]) is None
    assert sampling.expanded_tasks("a|5, g|0,b", {"g": ["x", "y", "x"]}) == ["a|5", "x|0", "y|0", "b"]


def test_schedules():
    good = {"sources": [1, 2], "names": ["a", "b"], "schedule": [{"schedule_type": "const", "weights": [1, 2]}, {"schedule_type": "changing", "init_weights": [1, 2], "end_weights": [2, 1]}]}
    assert sampling.checked_schedule(good) is good and sampling.checked_schedule({"names_weights": 1}) == {"names_weights": 1}
    for bad in ({"names": ["a", "a"]}, {"names": ["a"]}, {"schedule": [{"schedule_type": "odd"}]}, {"schedule": [{"schedule_type": "const", "weights": [1]}]}, {"schedule": [{"schedule_type": "changing", "init_weights": [1, 2], "end_weights": [1]}]}, {"concat_sources": [1]}):
        with pytest.raises(ValueError):
            sampling.checked_schedule(good | bad)


@pytest.mark.parametrize("files,buffer,read", [(6, 3, [0, 0, 0, 1, 1, 1]), (7, 3, [0, 0, 0, 1, 1, 1, 2, 2, 2]), (2, 3, [0, 0]), (3, 1, [0, 1, 2])])
def test_block_shuffle(spark, files, buffer, read):
    blocks = spark.createDataFrame([(f"f{i}", j) for i in range(files) for j in range(4)], "file string, block int")
    rows = sampling.shuffled_blocks(blocks, "file", "block", buffer, 1).orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(len(read) * 4)) and [r["buffer"] for r in rows] == [b for b in sorted(read) for _ in range(4)]
    if files == 7:  # the last buffer begins anew with the first files
        assert {r["file"] for r in rows if r["buffer"] == 2} == {"f0", "f1", "f2"} and "f6" not in {r["file"] for r in rows}


def test_tokenised(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "y"), (3, None, "z"), (4, " ", "w")], "k int, text string, ids string").withColumnRenamed("ids", "extra")
    encode = lambda texts: [[9, *map(len, t.split())] for t in texts]
    assert {r["k"]: (r["ids"], r["extra"]) for r in pairs.tokenised(df, "text", encode, 0, 9).collect()} == {1: ([1, 1, 0], "x"), 4: ([0], "w")}
    assert pairs.tokenised(df, "text", encode, 0).where("k = 1").first()["ids"] == [9, 1, 1, 0]


@pytest.mark.parametrize("partitions", [1, 3, 7])
@pytest.mark.parametrize("size", [1, 4, 64, 5_000])
def test_blocks_do_not_depend_on_partitions(spark, partitions, size):
    rows = [(i, list(range(i * 1_000, i * 1_000 + i * 7 % 41))) for i in range(120)] + [(500, list(range(9_000_000, 9_012_000)))]
    flat = [x for _, ids in rows for x in ids]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["block"]: r["block_ids"] for r in packing.pack_blocks(spark.createDataFrame(rows, "k int, ids array<int>"), ["k"], "ids", size).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {i: flat[i * size : (i + 1) * size] for i in range(len(flat) // size)}
    assert packing.pack_blocks(spark.createDataFrame([], "k int, ids array<int>"), ["k"], "ids", size).count() == 0


def test_pipelines(spark):
    text = "\n".join(["one line with several words in it", "again", "other  words that stay here", "again", "https://a.example/x", "last line of this short text"])
    df = spark.createDataFrame([(1, text, "k"), (2, "", "k"), (3, None, "k")], "id int, text string, program string").withColumnRenamed("program", "mine")
    got = {r["id"]: r for r in pipelines.refine_in_chunks(df, "text").collect()}
    assert got[1]["refined"] == "one line with several words in it\nagain\nother words that stay here\nlast line of this short text"
    assert (got[1]["chunks"], got[2]["chunks"], got[3]["chunks"], got[2]["status"], got[3]["status"], got[1]["mine"]) == (1, 0, 0, "empty_input", "empty_input", "k")
    small = {r["id"]: r for r in pipelines.refine_in_chunks(df, "text", budget=12).collect()}
    assert small[1]["chunks"] > 2 and "again\nother" in small[1]["refined"]

    class Failing:
        def programs(self, prompts):
            raise RuntimeError("no model")

    failed = {r["id"]: r for r in pipelines.refine_in_chunks(df, "text", Failing).collect()}
    assert len(failed) == 3 and "no model" in failed[1]["model_error"] and failed[1]["refined"] == text
    wrote = {r["id"]: r for r in pipelines.rewrite_in_chunks(df, "text", size=30).collect()}
    assert "".join(wrote[1]["programs"]).replace(" ", "") == text.replace(" ", "") and wrote[1]["num_chunks"] > 2 and wrote[3]["num_chunks"] == 0
    merged = pipelines.merge_rewrites(spark.createDataFrame([(["a", None, "b"], "t", "r")], "p array<string>, text string, raw_content string"), "p").first()
    assert (merged["raw_content"], merged["text"]) == ("ab", "t")


def test_order_of_rows(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 0), ("d", None)], "g string, i int")
    assert {r["g"]: r["has_gaps"] for r in pipelines.in_order(df, ["g"], "i").collect()} == {"a": False, "b": True, "c": True, "d": True}
    assert pipelines.without_gaps(df.where("g = 'a'"), ["g"], "i").count() == 2
    with pytest.raises(ValueError, match="missing or repeated"):
        pipelines.without_gaps(df, ["g"], "i")


@pytest.mark.parametrize(
    "prediction,truth,equal",
    [
        ("1/2", "1/2", True), ("1,000", "1000", True), ("50%", "0.5", True), ("0.5", "50", True), ("7", "8", False), ("", "0", False), ("(1, 2)", "(1.0, 2.00001)", True), ("[1,2]", "(1,2)", True), ("(1,2,3)", "(1,2)", False), ("{a}", "A", True),
        (r"\begin{pmatrix}1 & 2\\3 & 4\end{pmatrix}", r"\begin{bmatrix}1.0&2\\3&4\end{bmatrix}", True), (r"\begin{pmatrix}1 & 2\end{pmatrix}", r"\begin{pmatrix}1 & 3\end{pmatrix}", False), ("x = 5", "5", True), ("5.0", "y=5", True), ("area = 5", "5", False), ("x=2", "2 = x", True),
    ],
)
def test_answers_equal(prediction, truth, equal):
    assert scores.answers_equal(prediction, truth) is equal


def test_chrf(spark):
    score = lambda rows, **o: extraction.corpus_chrf(spark.createDataFrame(rows, "g string, p string"), "g", "p", **o).first()["chrf"]
    assert score([("the cat sat", "the cat sat")]) == pytest.approx(100) and score([("abc", "xyz")]) == 0 and score([("", "")]) == 0 and score([("a b", None)]) == 0
    assert score([("ab", "a b")]) == pytest.approx(100) and score([("a b", "ab")], words_=2) < 100
    # one order: three shared of four and five
    assert score([("abcd", "abcxy")], characters=1) == pytest.approx(100 * 5 * 0.6 * 0.75 / (4 * 0.6 + 0.75))
    assert extraction._split_punctuation('"Hi there!" (yes)') == ['"', "Hi", 'there!', '"', "(yes", ")"]


def test_registry(spark):
    df = spark.createDataFrame([("a", ["x"], ["x"], [-1.0, -2.0], ["x", "y"], [0], "t"), ("b", ["x"], ["z"], None, ["x", "y"], [0], "t")], "id string, golds array<string>, text array<string>, logprobs array<double>, choices array<string>, gold_index array<int>, task string")
    got = {r["score"]: (r["value"], r["samples"]) for r in scores.run_scores(df, list(scores.REGISTRY), ["task"]).collect()}
    assert set(got) == set(scores.REGISTRY) and got["acc"] == (1.0, 1) and got["em"] == (0.5, 2)
    with pytest.raises(ValueError, match="unknown scores: odd"):
        scores.run_scores(df, ["odd"], ["task"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", None), (2, None, 3)], "k bigint, t string, n bigint")
    shards.write_json_lines(df, f"{tmp_path}/lines")
    assert sorted(map(tuple, shards.read_json_lines(spark, f"{tmp_path}/lines", "k bigint, t string, n bigint", strict=True).collect())) == [(1, "a\nb", None), (2, None, 3)]
    for rank in (0, 1, 1):
        shards.write_statistics(spark.createDataFrame([(10 + rank,)], "documents bigint"), f"{tmp_path}/stats", rank)
    (tmp_path / "stats" / "old.json").write_text('{\n "rank": 7,\n "documents": 5\n}')
    assert {r["rank"]: r["documents"] for r in shards.read_statistics(spark, f"{tmp_path}/stats", "rank int, documents bigint").collect()} == {0: 10, 1: 11, 7: 5}
    for run, value in (("2024-01-01", 1), ("2024-02-01", 2)):
        shards.write_results(spark.createDataFrame([("x", value), ("y", value)], "task string, v int"), f"{tmp_path}/results", "task", "run", run)
    shards.write_results(spark.createDataFrame([("x", 9)], "task string, v int"), f"{tmp_path}/results", "task", "run", "2024-01-15")
    last, first = ({r["task"]: r["v"] for r in shards.read_results(spark, f"{tmp_path}/results", "task", "run", f).collect()} for f in (False, True))
    assert last == {"x": 2, "y": 2} and first == {"x": 1, "y": 1}


def test_compressed_lines(spark, tmp_path):
    import gzip

    zstandard = pytest.importorskip("zstandard")
    lines = b'{"raw_content": "some text", "source": "s"}\n{"raw_content": null, "source": "t"}\n'
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(lines))
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(lines))
    schema = "raw_content string, source string"
    try:
        found = shards.read_shards(spark, shards.shard_paths(str(tmp_path)), schema).select("raw_content", "source").collect()
        assert sorted(r["source"] for r in found) == ["s", "t"]
    except Exception as e:
        if "native" not in str(e).lower():
            raise
        pytest.skip("this Hadoop has no zstd")
    got = {r["meta"]["source"]: r["text"] for r in shards.read_adapted(spark, f"{tmp_path}/b.jsonl.gz", "redpajama", 100, schema=schema).collect()}
    assert got == {"s": "some text", "t": ""}


def test_marked_report(spark):
    means = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 1.0), ("n", "a", 0.25)], "model string, task string, v double")
    wide = scores.pivoted(means, "model", "task", "v")
    assert {r["model"]: (r["a"], r["b"], r["average"]) for r in wide.collect()} == {"m": (0.5, 1.0, 0.75), "n": (0.25, None, 0.25)}
    assert {r["model"]: r["b"] for r in scores.with_missing(wide, digits=2).collect()} == {"m": "1.00", "n": "N/A"}


def test_entry_without_what_the_subpackage_needs(monkeypatch):
    """If one of its modules cannot be imported, the other queries are there all the same."""
    for name in [m for m in sys.modules if m.startswith("siltmill." + "llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    entry = importlib.import_module("__spark_entry__")
    assert "refine_documents" in entry.queries() and not any(n.startswith("p1_") for n in entry.queries())
    sys.modules.pop("__spark_entry__")


def test_shared_folder_is_needed_on_clusters():
    from siltmill import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_transcripts(spark):
    text = "Let us see.\n```python\nimport math\nprint(1)\nx = 2\n```\n```output\n1\n```\nThen\n```python\nfrom os import path\ny = 1 / 0\n```\n```output\nZeroDivisionError\n```\nAgain\n```python\nz = x\nprint(z)\n```\n```output\n2\n```\nSo 2."
    parts = extraction.transcript_parts(text)
    assert [r for r, _ in parts] == ["rationale", "program", "output"] * 3 + ["rationale"] and parts[0][1] == "Let us see.\n" and parts[-1][1] == "So 2."
    made = "from os import path\nimport math\nx = 2\n\nz = x\nprint(z)\n"
    assert extraction.transcript_program(text) == made and extraction.transcript_program(text, last_only=True) == "z = x\nprint(z)\n"
    assert extraction.transcript_parts("```python\na\n```python\n") is None and extraction.transcript_parts("") == [] and extraction.transcript_program("no fences") == ""
    df = spark.createDataFrame([(1, text), (2, None)], "i int, t string")
    assert {r["i"]: r["p"] for r in df.select("i", extraction.program_of("t").alias("p")).collect()} == {1: made, 2: ""}


def test_diff_html(spark):
    df = spark.createDataFrame([("a<b c", "a<b d", 1), ("same", "same", 2), ("", "new", 3), (None, None, 4)], "a string, b string, i int")
    got = {r["i"]: r["h"] for r in df.select("i", pairs.diff_html("a", "b").alias("h")).collect()}
    assert got == {1: 'a&lt;b <del class="diff-del">c</del><ins class="diff-ins">d</ins>', 2: "same", 3: '<ins class="diff-ins">new</ins>', 4: ""}


def test_reading_normal(spark):
    df = spark.createDataFrame([("The twenty-one, 7 Dogs!", 1), ("3.50", 2), (None, 3)], "t string, i int")
    assert {r["i"]: r["n"] for r in df.select("i", scores.reading_normal("t").alias("n")).collect()} == {1: "twenty one 7.0 dogs", 2: "3.5", 3: ""}


def test_items(spark):
    e = one(spark, prompts.ending_item(F.lit("Baking"), F.lit("She took [header] dough."), F.lit("then SHE"), F.col("c"), F.lit("")), c=["ran [x] off", "sat"])
    assert (e["query"], e["choices"], e["gold_index"]) == ("Baking: She took dough. Then she ", [" ran off", " sat"], -1)
