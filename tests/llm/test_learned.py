import random

import numpy as np
import pytest

from siltmill.llm import abuse, page_body, truncation
from siltmill.llm.text_batch import TextBlock

RNG = random.Random(5)
NOUNS = "river market garden teacher winter paper window village engine letter".split()
VERBS = "crossed opened counted repaired carried watched followed painted".split()


def sentence(rng=RNG):
    return f"The {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} was {rng.choice(VERBS)} by the people of the {rng.choice(NOUNS)}."


def prose(rng=RNG):
    return " ".join(sentence(rng) for _ in range(rng.randint(2, 6)))


def whole(rng):
    kind = rng.random()
    if kind < 0.7:
        return prose(rng)
    if kind < 0.85:
        return prose(rng) + "\n- " + rng.choice(NOUNS).title()
    return "\n".join(f"* {rng.choice(VERBS)} {rng.choice(NOUNS)}s" for _ in range(8))


@pytest.fixture(scope="module")
def ends():
    rng = random.Random(1)
    return truncation.fit_ends([whole(rng) for _ in range(1500)], [None] * 1500)


def test_held_out_accuracy(ends):
    rng, gen = random.Random(2), np.random.default_rng(2)
    texts = [whole(rng) for _ in range(400)]
    cuts = [c for t in texts if (c := truncation.artificial_cut(t, gen))]
    found = lambda made: np.mean(ends.scores(ends.rows(made, [None] * len(made))) >= [ends.threshold(truncation.end_kind(t)) for t in made])
    assert found(cuts) > 0.85
    assert found(texts) < 0.03


def test_score_table(spark):
    rng = random.Random(3)
    rows = [(i, whole(rng), "a", 100) for i in range(400)] + [(1000, prose(rng)[:-20], "b", 100), (1001, None, "b", None), (1002, "  ", "b", 0), (1003, "", "b", -1)]
    df = spark.createDataFrame(rows, "chunk_id bigint, chunk_body string, key string, is_cut int")
    scored = truncation.score_ends(df, "chunk_id", "chunk_body", "is_cut", ("key",))
    got = {r["chunk_id"]: r for r in scored.collect()}
    assert len(got) == 404 and got[1000]["is_cut"] and not any(got[i]["is_cut"] for i in (1001, 1002, 1003))
    rate = {r["key"]: r["rows"] for r in truncation.cut_rate(scored, "key").collect()}
    assert rate == {"a": 400, "b": 4}
    few = truncation.score_ends(df.where("chunk_id >= 1000"), "chunk_id", "chunk_body", "is_cut").collect()
    assert [r["is_cut"] for r in sorted(few, key=lambda r: r["chunk_id"])][1:] == [False, False, False]
    assert truncation.score_ends(df.limit(0), "chunk_id", "chunk_body", "is_cut").count() == 0


@pytest.mark.parametrize("n", [1, 2, 30, 199, 201])
def test_small_tables_are_fitted_too(n):
    rng = random.Random(n)
    model = truncation.fit_ends([whole(rng) for _ in range(n)], [None] * n)
    assert isinstance(model, truncation.EndModel) and model.thresholds[""] > 0
    assert np.isfinite(model.scores(model.rows(["The river", "One."], [None, 3]))).all()
    assert truncation.fit_ends([None, " "], [None, 1]) is None


def test_every_row_is_fitted_on_or_held_out(spark, monkeypatch):
    """The model of a table in several shards knows every row: words, examples and thresholds come from all, wherever the rows lie."""
    rng = random.Random(6)
    rows = [(i, whole(rng), None) for i in range(900)] + [(900, "Two quokkas met.", None), (901, "More quokkas came.", None)]
    df = spark.createDataFrame(rows, "chunk_id bigint, chunk_body string, most int")
    numbers = set()
    monkeypatch.setattr(truncation, "SHARD", 200)
    monkeypatch.setattr(truncation, "calibrated", lambda counts, model: numbers.add(sum(int(n[0]) for (_, w), n in counts.items() if w == truncation.HELD)) or model)
    model = truncation.fitted_ends(df.repartition(3), "chunk_id", "chunk_body", "most")
    again = truncation.fitted_ends(df.orderBy("chunk_body").coalesce(1), "chunk_id", "chunk_body", "most")
    assert model.known.level("quokkas") == 2 and model.known.level("teacher") > 6
    assert np.array_equal(model.weights, again.weights)
    held = sum(np.random.default_rng((7, r["n"])).random() < truncation.HELD_OUT for r in df.selectExpr("pmod(xxhash64(chunk_id, chunk_body), 1L << 60) n").collect())
    assert numbers == {held}


def test_rows_are_scored_from_the_features_they_were_fitted_on(spark):
    """What is looked up once for a text gives each beginning of it the features of its own; a table's rows are scored by those, without their texts."""
    rng = random.Random(8)
    texts = [whole(rng) for _ in range(120)] + ["Das İstanbul ΣΑΣ' x. \0 odd\0 one. " * 3, "a.] b.* c。 d！ e\ud800 x" * 5, "Word. " * 90 + "Étéword", "no"]
    known, links = truncation.Words.of(truncation.Counter(w for t in texts for w in truncation.text_words(t))), page_body.sample_links(texts)
    for text in texts:
        found = truncation.Whole(text, known)
        for size in {*range(1, len(text), 7), len(text)}:
            t = text[:size]
            kind = truncation.end_kind(t)
            assert kind == truncation.end_kind(t, found)
            assert not t.strip() or truncation.features(t, 9, known, links, kind, {}) == truncation.features(t, 9, known, links, kind, {}, found)
    rows = [(i, whole(rng), f"s{i % 3}", 50) for i in range(300)] + [(900, None, "s", 1), (901, " ", "s", None), (902, "1 2 3 | | 4\n" * 40, "s", 0), (5, rows_text := prose(rng)[:-9], "s", 50), (5, rows_text, "s", 50)]
    df = spark.createDataFrame(rows, "id bigint, body string, src string, most int")
    by_text = truncation.score_ends(df, "id", "body", "most", ("src",), truncation.fitted_ends(df, "id", "body", "most"))
    by_row = truncation.score_ends(df, "id", "body", "most", ("src",))
    assert by_row.schema == by_text.schema and "body" not in by_row._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_text.collect())) and by_row.count() == len(rows)


def test_best_threshold():
    rng = np.random.default_rng(0)
    cut, ends = rng.beta(8, 2, 4000), rng.beta(2, 8, 4000)
    few, many = (np.concatenate((rng.beta(8, 2, int(8000 * x)), rng.beta(2, 8, int(8000 * (1 - x))))) for x in (0.02, 0.5))
    assert truncation.best_threshold(many, cut, ends) < 0.6 < truncation.best_threshold(few, cut, ends)


def test_artificial_ends_are_ends():
    rng, gen = random.Random(4), np.random.default_rng(4)
    for _ in range(200):
        text = whole(rng)
        if (end := truncation.artificial_end(text, gen, page_body.sample_links([]))) is not None:
            assert text.startswith(end) and (end[-1] in ".s" or end.endswith(tuple(NOUNS)))


def test_plain_spelling():
    made = {"$tup!d d!ckh3@d": "stupid dickhead", "fuсk": "fuck", "c o c k grew": "cock grew", "as_shole id-iot": "asshole idiot", "a​b": "ab", "12 plain words": "12 plain words"}
    for text, plain in made.items():
        assert abuse.plain_spelling(text) == plain
        assert abuse.respelled([text], {}).texts[0].lower() == plain


def labelled(n, rng):
    rows = []
    for i in range(n):
        bad = rng.random() < 0.2
        text = prose(rng)
        if bad:
            text += f" You are a worthless {rng.choice(['idiot', 'fool', 'pig'])}, {rng.choice(NOUNS)}. " + prose(rng)
        elif rng.random() < 0.2:
            text += f" The word {rng.choice(['idiot', 'fool'])} stands in the old dictionary."
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b"]), int(bad)))
    return rows


def test_abuse(spark):
    rows = labelled(900, random.Random(4))
    documents = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s, _ in rows] + [(5000, None, "en", "a", 0), (5001, "", None, None, 0), (5002, " ", "xx", "b", 0)], "doc_id bigint, text string, lang string, source string, abuse_score int")
    labels = spark.createDataFrame([(i, y) for i, _, _, _, y in rows if i < 700] + [(3, None), (99999, 1)], "doc_id bigint, toxic int")
    scored = abuse.score_abuse(documents, labels)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == 903 and not any(got[i]["is_abusive"] or got[i]["abuse_score"] for i in (5000, 5001, 5002))
    truth = {i: y for i, _, _, _, y in rows if i >= 700}
    hits = sum(got[i]["is_abusive"] for i, y in truth.items() if y)
    false = sum(got[i]["is_abusive"] for i, y in truth.items() if not y)
    assert hits >= 0.85 * sum(truth.values()) and false <= 0.05 * len(truth)
    assert sum(r["documents"] for r in abuse.abuse_rate(scored).collect()) == 903
    none = abuse.score_abuse(documents, labels.limit(0))
    assert none.where("is_abusive OR abuse_score > 0").count() == 0


def test_every_labelled_document_is_fitted_on_or_held_out(spark, monkeypatch):
    """Words that few of many labelled documents have are known, wherever the documents lie and in however many shards."""
    rng = random.Random(7)
    rare = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(300)]
    rows = [(i, f"The {rare[i // 6]} was {rng.choice(VERBS)}." if i < 1800 else sentence(rng) if i % 40 else "You worthless idiot.", "en", "a") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t, _, _ in rows], "doc_id bigint, toxic int")
    for name, n in (("SHARD", 4000), ("FIRST_STEPS", 300), ("STEPS", 300)):
        monkeypatch.setattr(abuse, name, n)
    judged = [abuse.judged_rows(x, labels, "doc_id", "text", "lang", "source", "toxic") for x in (df.repartition(5), df.coalesce(1))]
    model, again = map(abuse.fit_abuse, judged)
    buckets, _ = abuse.word_buckets(TextBlock(rare))
    assert model.known[buckets].mean() > 0.9
    assert np.array_equal(model.words, again.words) and model.thresholds == again.thresholds
    assert abuse.scores_of([r["words"] for r in judged[0].where("y = 1").limit(5).collect()], model).min() > model.threshold("en")


def test_pooling_against_a_loop():
    rng = np.random.default_rng(1)
    rows = [rng.integers(2, 50, n) for n in (7, 1, 0, 12)]
    model = abuse.fit_network([r for r in rows if len(r)] * 4, np.array([0, 1, 0] * 4, float))
    first = np.concatenate(([0], np.cumsum(list(map(len, rows)))))
    got = model.pooled(np.concatenate(rows), first)
    for d, r in enumerate(rows):
        ids = [x if model.known[x] else abuse.UNKNOWN for x in r] + [abuse.PAD] * (max(abuse.WIDTHS) - 1)
        for k, (w, f) in enumerate(zip(abuse.WIDTHS, model.filters)):
            if not len(r):
                assert not got[d].any()
                continue
            best = max((np.concatenate([model.words[x] for x in ids[i : i + w]]) @ f for i in range(len(r))), key=lambda v: v[0])
            assert got[d, k * abuse.FILTERS] == pytest.approx(max(0, best[0] + model.biases[k][0]), abs=1e-4)


def test_a_step_multiplies_each_distinct_word_once_and_follows_the_gradient(monkeypatch):
    """The change of a step against the gradient of a plain loss, by differences; words are projected once however often they stand in the documents."""
    rng = np.random.default_rng(3)
    rows = [rng.integers(2, 12, n) for n in (40, 3, 1, 90)]
    labels, weight, sizes = np.array([1.0, 0, 1, 0]), np.array([2.0, 1, 2, 1]), []
    monkeypatch.setattr(abuse, "convolved", lambda vectors, *a, of=abuse.convolved: sizes.append(len(vectors)) or of(vectors, *a))
    before, after = abuse.Training.start(1), abuse.Training.start(1)
    after.fit(rows, labels, weight, 0.01, np.random.default_rng(4))
    draw = np.random.default_rng(4)
    order = draw.permutation(4)
    keep = (draw.random((4, abuse.FILTERS * len(abuse.WIDTHS))) > 0.3) / 0.7

    def loss(words):
        filters, biases, out, out_bias = before.arrays()
        total = 0.0
        for i, d in enumerate(order):
            laid = words[[*rows[d], *[abuse.PAD] * (max(abuse.WIDTHS) - 1)]]
            tops = [np.max([laid[a : a + w].ravel() @ f for a in range(len(rows[d]))], 0) + b for w, f, b in zip(abuse.WIDTHS, filters, biases)]
            value = (np.maximum(np.concatenate(tops), 0) * keep[i]) @ out + out_bias[0]
            total += weight[d] * (np.log1p(np.exp(value)) - (labels[d] * 0.96 + 0.02) * value) / 4
        return total

    start = before.words.astype(np.float64)
    for word, place in ((2, 0), (5, 7), (11, 23)):
        step = np.zeros_like(start)
        step[word, place] = 1e-6
        wanted = (loss(start + step) - loss(start - step)) / 2e-6
        got = (before.words - after.words)[word, place] * np.sqrt(after.word_square[word]) / 0.05
        assert got == pytest.approx(wanted, abs=2e-4, rel=0.02)
    assert sizes == [11] and np.array_equal(before.words[12:], after.words[12:])


def test_hashes_of_words():
    block = TextBlock(["One two ONE", "", "two"])
    assert block.word_hash[0] == block.word_hash[2] != block.word_hash[1] == block.word_hash[3]
    assert block.word_text.tolist() == [0, 0, 0, 2]
