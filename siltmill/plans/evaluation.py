"""Queries: evaluation items, scores of answers, aggregates, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from ..operators import ordering, scores
from ..sources.tables import table
from .refining import TEXT, WORDS, WS, documents
from .registry import query


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Each answer once, with its item."""
    items = table(spark, d, "doc").select("id", "query", "choices", "gold_index")
    return table(spark, d, "model_response").distinct().join(items, "id").withColumn("golds", scores.golds(F.col("choices"), F.col("gold_index")))


_ANSWERS = """a AS (SELECT r.*, d.query, d.choices, d.gold_index, list_transform(d.gold_index, lambda i: d.choices[i + 1]) AS golds FROM (SELECT DISTINCT * FROM model_response) r JOIN doc d USING (id)),
s AS (SELECT * FROM a WHERE logprobs IS NOT NULL AND len(logprobs) = len(choices)), t AS (SELECT * FROM a WHERE text IS NOT NULL AND len(text) > 0)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).where("logprobs IS NOT NULL AND size(logprobs) = size(choices)")


def written(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).where("text IS NOT NULL AND size(text) > 0")


_BEST = lambda x: f"CAST(list_contains(gold_index, list_position({x}, list_max({x})) - 1) AS INT)"
_Z = "list_transform(range(len(logprobs)), lambda i: {})"


@query(
    f"""WITH {_ANSWERS}, n AS (SELECT *, {_Z.format('logprobs[i + 1] / length(choices[i + 1])')} AS by_char, {_Z.format('logprobs[i + 1] / len(output_tokens[i + 1])')} AS by_tok, {_Z.format('logprobs[i + 1] - unconditioned_logprobs[i + 1]')} AS by_pmi FROM s)
    SELECT id, model, {_BEST('logprobs')} AS acc, {_BEST('by_char')} AS acc_char, CASE WHEN len(output_tokens) = len(logprobs) THEN {_BEST('by_tok')} END AS acc_token, CASE WHEN len(unconditioned_logprobs) = len(logprobs) THEN {_BEST('by_pmi')} END AS acc_pmi FROM n"""
)
def mcq_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by raw, per-character, per-token and prior-corrected log-probabilities."""
    lp, gold = F.col("logprobs"), F.col("gold_index")
    same = lambda c: F.size(c) == F.size(lp)
    return scored(spark, d).select(
        "id", "model", scores.choice_accuracy(lp, gold).alias("acc"), scores.choice_accuracy(scores.by_characters(lp, F.col("choices")), gold).alias("acc_char"),
        F.when(same("output_tokens"), scores.choice_accuracy(scores.by_tokens(lp, F.col("output_tokens")), gold)).alias("acc_token"), F.when(same("unconditioned_logprobs"), scores.choice_accuracy(scores.by_prior(lp, F.col("unconditioned_logprobs")), gold)).alias("acc_pmi"),
    )


@query(
    f"""WITH {_ANSWERS} SELECT id, model, round(list_max(list_transform(gold_index, lambda g: exp(logprobs[g + 1]))) / list_sum(list_transform(logprobs, lambda x: exp(x))), 6) AS probability,
    round(1.0 / (list_min(list_transform(gold_index, lambda g: len(list_filter(logprobs, lambda x: x > logprobs[g + 1])))) + 1), 6) AS mrr FROM s"""
)
def mcq_probability(spark: SparkSession, d: str) -> DataFrame:
    lp, gold = F.col("logprobs"), F.col("gold_index")
    return scored(spark, d).select("id", "model", F.round(scores.gold_probability(lp, gold), 6).alias("probability"), F.round(scores.reciprocal_rank(lp, gold), 6).alias("mrr"))


@query(
    f"""WITH {_ANSWERS}, r AS (SELECT id, model, gold_index, list(i ORDER BY p DESC, i) AS o FROM (SELECT id, model, gold_index, unnest(logprobs) AS p, unnest(range(len(logprobs))) AS i FROM s) GROUP BY ALL)
    SELECT id, model, CAST(list_has_any(list_slice(o, 1, 2), r.gold_index) AS INT) AS recall_2, CAST(coalesce(s.logprobs[1] >= s.logprobs[2], true) AS INT) AS mc1, round(exp(s.logprobs[3]) / list_sum(list_transform(list_slice(s.logprobs, 3, 100), lambda x: exp(x))), 6) AS mc2 FROM r JOIN s USING (id, model)"""
)
def recall_and_truth(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 2, and the two truthfulness scores with two single-answer choices and one true one."""
    lp = F.col("logprobs")
    one, two = scores.truth_scores(lp, 2, F.lit(1))
    return scored(spark, d).select("id", "model", scores.recall_at(lp, F.col("gold_index"), 2).alias("recall_2"), one.alias("mc1"), F.round(two, 6).alias("mc2"))


@query(f"WITH {_ANSWERS} SELECT model, task_name, count(*) AS answers, CAST(count(*) FILTER (list_contains(argmax_logits_eq_gold, true)) AS BIGINT) AS gold_likelihood FROM a WHERE argmax_logits_eq_gold IS NOT NULL GROUP BY ALL")
def gold_likelihood(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).where("argmax_logits_eq_gold IS NOT NULL")
    return rows.groupBy("model", "task_name").agg(F.count("*").alias("answers"), F.count_if(F.array_contains("argmax_logits_eq_gold", True)).alias("gold_likelihood"))


_W = lambda x: f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> '')"
_PAIRS = _ANSWERS + ", p AS (SELECT id, model, unnest(golds) AS g, t FROM (SELECT id, model, golds, unnest(text) AS t FROM t))"


@query(
    f"""WITH {_PAIRS}, b AS (SELECT *, list_distinct({_W('g')}) AS x, list_distinct({_W('t')}) AS y FROM p) SELECT id, model, CAST(max(CASE WHEN t <> '' AND trim(g) = trim(t) THEN 1 ELSE 0 END) AS INT) AS exact, CAST(max(CASE WHEN t <> '' AND starts_with(trim(t), trim(g)) THEN 1 ELSE 0 END) AS INT) AS prefix,
    round(max(CASE WHEN len(x) + len(y) = 0 THEN 0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END), 6) AS f1 FROM b GROUP BY ALL"""
)
def exact_match_f1(spark: SparkSession, d: str) -> DataFrame:
    g, p = F.col("golds"), F.col("text")
    return written(spark, d).where(F.exists("text", lambda t: t.isNotNull())).withColumn("text", F.filter("text", lambda t: t.isNotNull())).select(
        "id", "model", scores.best_pair(g, p, scores.exact_match).alias("exact"), scores.best_pair(g, p, lambda a, b: scores.exact_match(a, b, "prefix")).alias("prefix"), F.round(scores.best_pair(g, p, scores.bag_f1), 6).alias("f1")
    )


_NGRAMS = lambda x, n: f"list_transform(range(greatest(len({x}) - {n - 1}, 0)), lambda i: array_to_string(list_slice({x}, i + 1, i + {n}), ' '))"
_SHARED = lambda a, b: f"list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda x: x = g)))))"


@query(
    f"""WITH {_ANSWERS}, p AS (SELECT id, model, {_W('golds[1]')} AS a, {_W("coalesce(text[1], '')")} AS b FROM t WHERE len(golds) > 0), n AS (SELECT *, {_NGRAMS('a', 2)} AS a2, {_NGRAMS('b', 2)} AS b2 FROM p)
    SELECT id, model, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2.0 * coalesce({_SHARED('a', 'b')}, 0) / (len(a) + len(b)) END, 6) AS rouge1, round(CASE WHEN len(a2) + len(b2) = 0 THEN 0 ELSE 2.0 * coalesce({_SHARED('a2', 'b2')}, 0) / (len(a2) + len(b2)) END, 6) AS rouge2,
    round(CASE WHEN len(b) = 0 THEN 0 ELSE coalesce({_SHARED('a', 'b')}, 0) / len(b) * CASE WHEN len(b) > len(a) THEN 1 ELSE exp(1 - len(a) / len(b)) END END, 6) AS bleu1,
    CAST(coalesce(list_position(list_transform(range(greatest(len(a), len(b))), lambda i: i < len(a) AND i < len(b) AND a[i + 1] = b[i + 1]), false) - 1, greatest(len(a), len(b))) AS BIGINT) AS common_prefix FROM n"""
)
def ngram_scores(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the first answer with the first gold in words and pairs of words."""
    g, p = F.get("golds", F.lit(0)), F.coalesce(F.get("text", F.lit(0)), F.lit(""))
    rows = written(spark, d).where("size(golds) > 0")
    return rows.select("id", "model", F.round(scores.rouge_n(g, p, 1), 6).alias("rouge1"), F.round(scores.rouge_n(g, p, 2), 6).alias("rouge2"), F.round(scores.bleu_n(g, p, 1), 6).alias("bleu1"), scores.common_prefix(g, p).alias("common_prefix"))


@query()
def sequence_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores that need a sequence comparison: longest common subsequence, edit distance in words, best assignment."""
    rows = written(spark, d).where("size(golds) > 0").select("id", "model", "golds", "text", F.get("golds", F.lit(0)).alias("g"), F.coalesce(F.get("text", F.lit(0)), F.lit("")).alias("p"))
    return rows.select("id", "model", F.round(scores.longest_common_f1("g", "p"), 6).alias("rouge_l"), scores.word_edits("g", "p").alias("edits"), F.round(scores.assigned_f1("golds", "text"), 6).alias("assigned_f1"))


@query(
    f"""WITH {_ANSWERS}, l AS (SELECT id, list(coalesce(text[1], '') ORDER BY model) AS v FROM t GROUP BY id), m AS (SELECT id, v, list_transform(v, lambda x: len(list_filter(v, lambda y: y = x))) AS k FROM l) SELECT id, v[list_position(k, list_max(k))] AS majority, CAST(len(v) AS BIGINT) AS votes FROM m"""
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    votes = written(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("model", F.coalesce(F.get("text", F.lit(0)), F.lit("")).alias("t")))), lambda x: x["t"]).alias("v"))
    return votes.select("id", scores.majority(F.col("v")).alias("majority"), F.size("v").cast("bigint").alias("votes"))


@query(
    """WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id)
    SELECT user_id, round(CASE WHEN n - c < 3 THEN 1 ELSE 1 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 3.0 / i)), 1) END, 6) AS pass_3,
    round(c * (c - 1.0) * (3 * (n - c) + c - 2) / (n * (n - 1.0) * (n - 2)), 6) AS half_of_3 FROM g WHERE n >= 3"""
)
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Chances over samples; a user's events stand in for samples of an item, purchases for correct ones."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c")).where("n >= 3")
    return counts.select("user_id", F.round(scores.pass_at_k(F.col("n"), F.col("c"), 3), 6).alias("pass_3"), F.round(scores.many_of_k(F.col("n"), F.col("c"), 3, 0.5), 6).alias("half_of_3"))


@query(
    f"""WITH {_ANSWERS}, x AS (SELECT model, list_sum(logprobs) AS lp, {WORDS('query')} AS w, strlen(query) AS b FROM s)
    SELECT model, round(exp(-sum(lp) / sum(w)), 6) AS word_perplexity, round(exp(-sum(lp) / sum(b)), 6) AS byte_perplexity, round(-sum(lp) / sum(b) / ln(2), 6) AS bits_per_byte, round(-avg(lp), 6) AS log_perplexity FROM x GROUP BY model"""
)
def perplexity(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("model", F.aggregate("logprobs", F.lit(0.0), lambda a, b: a + b).alias("lp"), T.word_count(F.col("query")).alias("w"), F.octet_length("query").alias("b"))
    total = F.sum("lp")
    return rows.groupBy("model").agg(F.round(F.exp(-total / F.sum("w")), 6).alias("word_perplexity"), F.round(F.exp(-total / F.sum("b")), 6).alias("byte_perplexity"), F.round(-total / F.sum("b") / F.log(F.lit(2.0)), 6).alias("bits_per_byte"), F.round(-F.avg("lp"), 6).alias("log_perplexity"))


_ACC = f"WITH {_ANSWERS}, c AS (SELECT id, model, task_name, {_BEST('logprobs')} AS acc FROM s)"


def accuracies(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", "model", "task_name", scores.choice_accuracy(F.col("logprobs"), F.col("gold_index")).alias("acc"))


@query(_ACC + ", k AS (SELECT model, task_name, avg(acc) AS v FROM c GROUP BY ALL) SELECT 'task' AS level, model || ':' || task_name AS name, round(v, 6) AS value FROM k UNION ALL SELECT 'group', model, round(avg(v), 6) FROM k GROUP BY model HAVING count(*) > 1 UNION ALL SELECT 'all', 'all', round(avg(v), 6) FROM k")
def metric_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scores.grouped_means(accuracies(spark, d), "model", "task_name", "acc").select("level", "name", F.round("value", 6).alias("value"))


@query(_ACC + " SELECT model, task_name, round(avg(acc), 6) AS mean, round(stddev_samp(acc) / sqrt(count(*)), 6) AS stderr, count(*) AS samples, max(acc) AS highest, min(acc) AS lowest FROM c GROUP BY ALL")
def mean_stderr(spark: SparkSession, d: str) -> DataFrame:
    means = accuracies(spark, d).groupBy("model", "task_name").agg(*scores.mean_error("acc"), F.max("acc").alias("highest"), F.min("acc").alias("lowest"))
    return means.select("model", "task_name", F.round("mean", 6).alias("mean"), F.round("stderr", 6).alias("stderr"), "samples", "highest", "lowest")


_EDGES = "[0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]"


@query(
    _ACC
    + f""", u AS (SELECT acc, turn, CAST(('0x' || substr(sha256('11:' || turn || ':' || id || ':' || model), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM c, (SELECT unnest(range(1, 201)) AS turn)),
    m AS (SELECT turn, sum(acc * len(list_filter({_EDGES}, lambda e: u >= e))) / sum(len(list_filter({_EDGES}, lambda e: u >= e))) AS mean FROM u GROUP BY turn) SELECT round(stddev_samp(mean), 6) AS stderr, count(*) AS turns FROM m"""
)
def bootstrap_stderr(spark: SparkSession, d: str) -> DataFrame:
    return scores.bootstrap_error(accuracies(spark, d), ["id", "model"], "acc", 200, 11).select(F.round("stderr", 6).alias("stderr"), "turns")


_MEANS = _ACC + ", k AS (SELECT model, task_name, avg(acc) AS v FROM c GROUP BY ALL) SELECT model, task_name, v FROM k"


@query(f"SELECT p.*, m.average FROM (PIVOT ({_MEANS}) ON task_name USING round(any_value(v), 6) GROUP BY model) p JOIN (SELECT model, round(avg(v), 6) AS average FROM ({_MEANS}) GROUP BY model) m USING (model)")
def pivot_results(spark: SparkSession, d: str) -> DataFrame:
    """A row for each model, a column for each task, and the mean over the tasks that the model has."""
    means = accuracies(spark, d).groupBy("model", "task_name").agg(F.avg("acc").alias("v"))
    return scores.pivoted(means, "model", "task_name", "v")


@query(
    """SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn,
    round((count(*) FILTER (t AND g) * count(*) FILTER (NOT t AND NOT g) - CAST(count(*) FILTER (NOT t AND g) * count(*) FILTER (t AND NOT g) AS DOUBLE)) / sqrt(CAST(count(*) FILTER (g) AS DOUBLE) * count(*) FILTER (t) * count(*) FILTER (NOT g) * count(*) FILTER (NOT t)), 6) AS mcc,
    round(2.0 * count(*) FILTER (t AND g) / (2 * count(*) FILTER (t AND g) + count(*) FILTER (NOT t AND g) + count(*) FILTER (t AND NOT g)), 6) AS f1 FROM (SELECT toxic = 1 AS t, quality <= 1 AS g FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL)"""
)
def mcc_f1(spark: SparkSession, d: str) -> DataFrame:
    """How well low quality tells toxic documents."""
    rows = table(spark, d, "labels").where("toxic IS NOT NULL AND quality IS NOT NULL")
    counts = rows.agg(*scores.confusion(F.col("toxic") == 1, F.col("quality") <= 1))
    return counts.select("*", F.round(scores.matthews(), 6).alias("mcc"), F.round(scores.f1_score(), 6).alias("f1"))


@query("SELECT run_id, arg_max(wall_seconds_total, rank) AS wall_seconds_total FROM rank_stats WHERE wall_seconds_total IS NOT NULL GROUP BY run_id")
def latest_result(spark: SparkSession, d: str) -> DataFrame:
    """The result of the last rank of each run, as an example of latest-by-key."""
    return scores.latest_by(table(spark, d, "rank_stats").where("wall_seconds_total IS NOT NULL"), ["run_id"], "rank", "documents", "wall_seconds_total")


@query(
    """WITH m AS (UNPIVOT (SELECT run_id, rank, CAST(documents AS DOUBLE) AS documents, CAST(input_lines AS DOUBLE) AS word_perplexity, CASE WHEN rank % 2 = 0 THEN CAST(output_lines AS DOUBLE) END AS acc FROM rank_stats) ON documents, word_perplexity, acc INTO NAME metric VALUE value)
    SELECT run_id, rank, arg_min(metric, p) AS metric, arg_min(value, p) AS value FROM (SELECT *, CASE metric WHEN 'acc' THEN 1 WHEN 'word_perplexity' THEN 2 ELSE 5 END AS p FROM m) GROUP BY ALL"""
)
def metric_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of each run and rank the metric that comes first in the order of preference."""
    rows = table(spark, d, "rank_stats").select("run_id", "rank", F.col("documents").cast("double").alias("documents"), F.col("input_lines").cast("double").alias("word_perplexity"), F.when(F.col("rank") % 2 == 0, F.col("output_lines").cast("double")).alias("acc"))
    long = rows.unpivot(["run_id", "rank"], ["documents", "word_perplexity", "acc"], "metric", "value").where("value IS NOT NULL")
    return scores.preferred(long, ["run_id", "rank"], "metric", "value", ["acc", "word_perplexity", "byte_perplexity", "bits_per_byte"])


@query(
    rf"""WITH t AS (SELECT doc_id, {TEXT} AS t FROM documents), x AS (SELECT doc_id, regexp_extract_all(t, '\\boxed\{{((?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*)\}}', 1) AS b, regexp_extract(t, 'answer is:?\s*([^\n.]+)', 1) AS s, regexp_extract_all(t, '-?[0-9][0-9,]*(?:\.[0-9]+)?') AS n FROM t)
    SELECT doc_id, md5(CASE WHEN len(b) > 0 THEN b[-1] WHEN s <> '' THEN trim(s) WHEN len(n) > 0 THEN replace(n[-1], ',', '') ELSE '' END) AS answer FROM x"""
)
def final_answers(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(scores.final_answer(F.col("text"))).alias("answer"))


@query(
    """WITH p AS (SELECT a.run_id, a.rank AS rank_a, b.rank AS rank_b, a.documents AS x, b.documents AS y FROM rank_stats a JOIN rank_stats b ON a.run_id = b.run_id AND a.rank + 1 = b.rank), s AS (SELECT *, CAST(x AS VARCHAR) AS u, CASE WHEN rank_b % 2 = 0 THEN CAST(x AS VARCHAR) || '00%' ELSE CAST(y AS VARCHAR) END AS v FROM p),
    n AS (SELECT *, CAST(x AS DOUBLE) AS f, CASE WHEN rank_b % 2 = 0 THEN CAST(x AS DOUBLE) ELSE CAST(y AS DOUBLE) END AS g FROM s)
    SELECT run_id, rank_a, rank_b, u = v OR abs(f - g) <= 1e-4 * greatest(abs(f), abs(g)) OR abs(f / 100 - g) <= 1e-4 * greatest(abs(f / 100), abs(g)) OR abs(f * 100 - g) <= 1e-4 * greatest(abs(f * 100), abs(g)) AS equal FROM n"""
)
def number_equality(spark: SparkSession, d: str) -> DataFrame:
    """Figures of each rank and the next of a run compared as answers, some of them written as percentages."""
    stats = table(spark, d, "rank_stats").select("run_id", "rank", "documents")
    a, b = stats.selectExpr("run_id", "rank AS rank_a", "documents AS x"), stats.selectExpr("run_id", "rank AS rank_b", "documents AS y")
    rows = a.withColumn("rank_b", F.col("rank_a") + 1).join(b, ["run_id", "rank_b"])
    u = F.col("x").cast("string")
    v = F.when(F.col("rank_b") % 2 == 0, F.concat(u, F.lit("00%"))).otherwise(F.col("y").cast("string"))
    return rows.select("run_id", "rank_a", "rank_b", scores.numbers_equal(u, v).alias("equal"))


@query(
    f"""WITH w AS (SELECT id, {_W('query')} AS a, {_W("coalesce(choices[1], '')")} AS b FROM doc), n AS (SELECT *, {_NGRAMS('a', 2)} AS a2, list_distinct({_NGRAMS('b', 2)}) AS b2 FROM w)
    SELECT id, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) / len(list_distinct(b)) END, 6) AS novel_1, round(CASE WHEN len(b2) = 0 THEN 0 ELSE len(list_filter(b2, lambda x: NOT list_contains(a2, x))) / len(b2) END, 6) AS novel_2 FROM n"""
)
def ngram_novelty(spark: SparkSession, d: str) -> DataFrame:
    q, c = F.col("query"), F.coalesce(F.get("choices", F.lit(0)), F.lit(""))
    return table(spark, d, "doc").select("id", F.round(scores.novel_share(q, c, 1), 6).alias("novel_1"), F.round(scores.novel_share(q, c, 2), 6).alias("novel_2"))


@query("SELECT source_parquet, source_row_index, arg_max(language_score, (ingested_at, id, language_score)) AS last_score, arg_min(language_score, (ingested_at, id, language_score)) AS first_score FROM crawl_rows GROUP BY ALL")
def dedup_first_last(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("ingested_at", "id", "language_score")
    return table(spark, d, "crawl_rows").groupBy("source_parquet", "source_row_index").agg(F.max_by("language_score", order).alias("last_score"), F.min_by("language_score", order).alias("first_score"))


@query("SELECT 'item' AS type, id, CAST(length(query) AS BIGINT) AS chars FROM (SELECT id, any_value(query) AS query FROM doc GROUP BY id) UNION ALL SELECT 'answer', id || '/' || model, CAST(sum(length(coalesce(text[1], ''))) AS BIGINT) FROM (SELECT DISTINCT * FROM model_response) GROUP BY id, model")
def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    """Parts of different shape under one schema, each with its type."""
    items = table(spark, d, "doc").groupBy("id").agg(F.first("query").alias("q")).select(F.lit("item").alias("type"), "id", F.length("q").cast("bigint").alias("chars"))
    own = table(spark, d, "model_response").distinct().groupBy("id", "model").agg(F.sum(F.length(F.coalesce(F.get("text", F.lit(0)), F.lit("")))).alias("chars"))
    return items.unionByName(own.select(F.lit("answer").alias("type"), F.concat_ws("/", "id", "model").alias("id"), "chars"))


@query("SELECT id, md5(array_to_string(choices, '')) AS content FROM doc")
def chat_content(spark: SparkSession, d: str) -> DataFrame:
    """Message contents in their three forms (string, list of strings, list of blocks) brought to one string."""
    block = F.to_json(F.transform("choices", lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))))
    plain = F.array_join("choices", "")
    form = F.pmod(F.xxhash64("id"), F.lit(3))
    content = F.when(form == 0, plain).when(form == 1, F.to_json("choices")).otherwise(block)
    return table(spark, d, "doc").select("id", F.md5(T.joined_chat_content(content)).alias("content"))


@query(
    """SELECT id, md5('Question: ' || query || chr(10) || array_to_string(list_transform(range(len(choices)), lambda i: ' ' || chr(CAST(65 + i AS INT)) || '. ' || choices[i + 1]), chr(10)) || chr(10) || 'Answer:') AS lettered, md5('Question: ' || query || chr(10) || 'Answer:') AS plain,
    md5('[SYSTEM]' || chr(10) || 'Answer.' || chr(10) || '[USER]' || chr(10) || query || chr(10) || '[ASSISTANT]' || chr(10)) AS chat, ' ' || chr(65 + gold_index[1]) AS target FROM doc"""
)
def prompts_of_items(spark: SparkSession, d: str) -> DataFrame:
    q, c = F.col("query"), F.col("choices")
    target = F.get(prompts.multiple_choice_targets(c), F.get("gold_index", F.lit(0)))
    return table(spark, d, "doc").select("id", F.md5(prompts.multiple_choice(q, c)).alias("lettered"), F.md5(prompts.multiple_choice(q, c, "none")).alias("plain"), F.md5(prompts.chat(F.lit("Answer."), q)).alias("chat"), target.alias("target"))


@query("WITH r AS (SELECT doc_id, list(quality ORDER BY labelled_at, quality) AS s FROM labels WHERE quality IS NOT NULL GROUP BY doc_id), w AS (SELECT max(len(s)) AS m FROM r) SELECT CAST(i AS BIGINT) AS col, round(100 * avg(CASE WHEN s[least(i, len(s))] >= 3 THEN 1.0 ELSE 0 END), 1) AS accuracy FROM r, (SELECT unnest(range(1, m + 1)) AS i FROM w) GROUP BY i")
def padded_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Mean accuracy by turn; documents with fewer turns keep their last one. Each document's last value counts from the turn behind its last on, so only
    its own turns become rows."""
    rows = table(spark, d, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("labelled_at", "quality"))), lambda x: (x["quality"] >= 3).cast("int")).alias("s"))
    n, last = F.size("s"), F.element_at("s", -1)
    steps = F.transform("s", lambda x, i: F.struct((i + 1).alias("col"), x.alias("hits"), F.lit(0).alias("kept"), F.when(i == 0, 1).otherwise(0).alias("documents")))
    steps = F.concat(steps, F.array(F.struct((n + 1).alias("col"), F.lit(0).alias("hits"), last.alias("kept"), F.lit(0).alias("documents"))))
    sums = rows.select(F.explode(steps).alias("x")).groupBy("x.col").agg(F.sum("x.hits").alias("hits"), F.sum("x.kept").alias("kept"), F.sum("x.documents").alias("documents"))
    # one row for each turn: no more than the longest document has
    upto = Window.orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    done = sums.withColumn("total", F.sum("kept").over(upto) + F.col("hits")).withColumn("all", F.sum("documents").over(upto)).withColumn("widest", F.max("col").over(Window.partitionBy()))
    return done.where("col < widest").select(F.col("col").cast("bigint").alias("col"), F.round(100 * F.col("total") / F.col("all"), 1).alias("accuracy"))


@query(f"WITH {_ANSWERS}, x AS (SELECT model, unnest(logprobs) AS lp, unnest(argmax_logits_eq_gold) AS ok FROM s WHERE len(argmax_logits_eq_gold) = len(logprobs)) SELECT model, round(-sum(lp), 4) AS loss, count(*) AS tokens, round(-sum(lp) / count(*), 6) AS log_perplexity, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS accuracy FROM x GROUP BY model")
def token_loss(spark: SparkSession, d: str) -> DataFrame:
    """Summed loss, perplexity and accuracy over positions whose log-probabilities are given."""
    rows = scored(spark, d).where(F.size("argmax_logits_eq_gold") == F.size("logprobs")).select("model", F.explode(F.arrays_zip("logprobs", "argmax_logits_eq_gold")).alias("x"))
    return rows.groupBy("model").agg(F.round(-F.sum("x.logprobs"), 4).alias("loss"), F.count("*").alias("tokens"), F.round(-F.avg("x.logprobs"), 6).alias("log_perplexity"), F.round(F.avg(F.when(F.col("x.argmax_logits_eq_gold"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, count(*) AS samples FROM documents GROUP BY source")
def source_counters(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("samples"))


@query("SELECT vec_id, label, round(embedding[1], 5) AS first_score, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best, list_position(embedding, list_max(embedding)) - 1 = label AS correct FROM embeddings")
def vector_choice(spark: SparkSession, d: str) -> DataFrame:
    """Arg-max over score vectors."""
    best = scores.best_choice(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_score"), best.alias("best"), (best == F.col("label")).alias("correct"))


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 15")
def longest_documents(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return ordering.top_rows(documents(spark, d).select("doc_id", F.length("text").cast("bigint").alias("chars")), "chars", "doc_id", 15)
