"""Queries: answers and outputs taken out of texts, corpus aggregates, inspection of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from ..operators import extraction, scores
from ..sources.tables import table
from .evaluation import _ANSWERS, _NGRAMS, _SHARED, _W, written
from .refining import TEXT, documents, refined_chunks
from .registry import query


@query("SELECT source_parquet, count(*) AS chunks, CAST(count(*) FILTER (lower(trim(finish_reason)) IN ('length', 'max_tokens')) AS BIGINT) AS stopped FROM denoise_dataset GROUP BY source_parquet")
def limit_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose model run stopped at its limit, by source."""
    return table(spark, d, "denoise_dataset").groupBy("source_parquet").agg(F.count("*").alias("chunks"), F.count_if(extraction.cut_warnings(F.col("finish_reason"))).alias("stopped"))


@query("SELECT id, query AS first_output, CAST(2 AS BIGINT) AS outputs, 'x = 1' AS code FROM doc")
def transcript_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs and programs of a transcript, here made of the item's own text."""
    t = F.concat(F.lit("text\n```python\nx = 1\n```\n```output\n"), F.col("query"), F.lit("\n```\nmore\n```output\n2\n```\n"))
    outputs = extraction.output_blocks(t)
    return table(spark, d, "doc").select("id", F.get(outputs, F.lit(0)).alias("first_output"), F.size(outputs).cast("bigint").alias("outputs"), F.get(extraction.code_blocks(t), F.lit(0)).alias("code"))


@query(
    f"""WITH {_ANSWERS}, p AS (SELECT {_W('golds[1]')} AS a, {_W("coalesce(text[1], '')")} AS b FROM t WHERE len(golds) > 0), n AS (SELECT *, {_NGRAMS('a', 2)} AS a2, {_NGRAMS('b', 2)} AS b2 FROM p),
    sm AS (SELECT sum(len(a)) AS g, sum(len(b)) AS w, sum(coalesce({_SHARED('a', 'b')}, 0)) AS h1, sum(coalesce({_SHARED('a2', 'b2')}, 0)) AS h2, sum(len(b2)) AS n2 FROM n)
    SELECT CAST(g AS BIGINT) AS gold_words, CAST(w AS BIGINT) AS words, round(100 * CASE WHEN w > g THEN 1 ELSE exp(1 - g / w) END * exp((ln(h1 / w) + ln(h2 / n2)) / 2), 6) AS bleu FROM sm"""
)
def corpus_bleu(spark: SparkSession, d: str) -> DataFrame:
    rows = written(spark, d).where("size(golds) > 0").select(F.get("golds", F.lit(0)).alias("g"), F.coalesce(F.get("text", F.lit(0)), F.lit("")).alias("p"))
    return extraction.corpus_bleu(rows, "g", "p", 2).select("gold_words", "words", F.round("bleu", 6).alias("bleu"))


@query(
    """WITH l AS (SELECT quality AS t, CASE WHEN toxic = 1 THEN 1 ELSE quality END AS g FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), c AS (SELECT DISTINCT t AS c FROM l UNION SELECT DISTINCT g FROM l),
    e AS (SELECT c, count(*) FILTER (t = c AND g = c) AS tp, count(*) FILTER (t <> c AND g = c) AS fp, count(*) FILTER (t = c AND g <> c) AS fn FROM c, l GROUP BY c), f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM e)
    SELECT round(avg(f1), 6) AS macro, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted, round(sum(tp) / sum(tp + fn), 6) AS micro FROM f"""
)
def class_f1(spark: SparkSession, d: str) -> DataFrame:
    """F1 over several classes: quality against quality with toxic documents put down to 1."""
    rows = table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("quality").alias("t"), F.when(F.col("toxic") == 1, 1).otherwise(F.col("quality")).alias("g"))
    return extraction.class_f1(rows, "t", "g").select(*(F.round(c, 6).alias(c) for c in ("macro", "weighted", "micro")))


@query()
def extractive_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, density and compression of edited chunks against what they were."""
    own = extraction.extractive_statistics(refined_chunks(spark, d), "chunk_id", "chunk_body", "edited")
    return own.select("chunk_id", *(F.round(c, 6).alias(c) for c in ("coverage", "density", "compression")))


@query()
def latex_answers(spark: SparkSession, d: str) -> DataFrame:
    """Final answers of the documents in one spelling."""
    return documents(spark, d).select("doc_id", scores.final_answer(F.col("text")).alias("a")).select("doc_id", F.md5(extraction.latex_normal("a")).alias("answer"))


@query(
    f"""WITH l AS (SELECT doc_id, list_transform(range(len(a)), lambda i: '[' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || ']' || a[i + 1]) AS l FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS a FROM documents)),
    x AS (SELECT doc_id, line, i, tok, sum(tok) OVER (PARTITION BY doc_id ORDER BY i) - tok AS before FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, greatest(1, (length(unnest(l)) + 3) // 4) AS tok FROM l))
    SELECT doc_id, md5(string_agg(CASE WHEN before + tok <= 300 THEN line ELSE substr(line, 1, CAST((300 - before) * 4 AS BIGINT)) END, chr(10) ORDER BY i)) AS numbered FROM x WHERE before < 300 GROUP BY doc_id"""
)
def numbered_text(spark: SparkSession, d: str) -> DataFrame:
    """Numbered text up to 300 tokens, the line that passes them cut."""
    own = documents(spark, d).select("doc_id", T.labelled_lines(F.col("text")).alias("lines"))
    own = own.withColumn("tokens", F.transform("lines", lambda x: T.token_estimate(x)))
    return own.select("doc_id", F.md5(extraction.numbered_text(F.col("lines"), F.col("tokens"), 300)).alias("numbered"))


@query("SELECT id, gold_index[1] AS gold, upper(left(query, 1)) || substr(query, 2) = query AS starts_upper, md5(CASE WHEN regexp_matches(rtrim(query), '[.!?]$') THEN rtrim(query) ELSE rtrim(query) || '.' END) AS stopped, md5(query || ' (True or False)') AS truth, CAST(list_position(['A', 'B', 'C', 'D', 'E'], chr(65 + gold_index[1])) - 1 AS BIGINT) AS from_letter FROM doc")
def item_projection(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a data set made items: gold index from a letter, repaired sentences, closed questions."""
    q, gold = F.col("query"), F.get("gold_index", F.lit(0))
    return table(spark, d, "doc").select(
        "id", gold.alias("gold"), (prompts.sentence_start(q) == q).alias("starts_upper"), F.md5(prompts.with_full_stop(q)).alias("stopped"), F.md5(prompts.yes_no_question(q, "truth")).alias("truth"), prompts.gold_from_letter(F.char(gold + 65)).alias("from_letter")
    )


@query("SELECT id, md5(trim(query) || chr(10) || 'Answer Choices: ' || array_to_string(list_transform(range(len(choices)), lambda i: '(' || chr(CAST(65 + i AS INT)) || ') ' || choices[i + 1]), ' ')) AS question, replace(regexp_extract(query, '-?[0-9][0-9,]*(?:\\.[0-9]+)?'), ',', '') AS number FROM doc")
def item_questions(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    asked = extraction.question({"question": q, "options": F.col("choices")}, "options")
    return table(spark, d, "doc").select("id", F.md5(asked).alias("question"), extraction.ground_truth(q, "number").alias("number"))


@query(f"SELECT doc_id, md5({TEXT}) AS before, source, url, md5(coalesce(nullif(trim(lang), ''), 'unknown')) AS program FROM documents WHERE text IS NOT NULL ORDER BY source, doc_id LIMIT 12")
def inspect_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first texts over the sorted shards, with what a viewer shows of a row."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").orderBy("source", "doc_id").limit(12)
    return rows.select("doc_id", F.md5(T.first_filled(F.col("text"))).alias("before"), "source", "url", F.md5(F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("unknown"))).alias("program"))


@query(r"SELECT id, CASE WHEN len(regexp_extract_all(query, '([0-9]+) (?:coins|stone)')) > 0 THEN regexp_extract_all(query, '([0-9]+) (?:coins|stone)', 1)[-1] WHEN len(regexp_extract_all(query, '([0-9]+)')) > 0 THEN regexp_extract_all(query, '([0-9]+)', 1)[-1] ELSE '' END AS found FROM doc")
def pattern_priority(spark: SparkSession, d: str) -> DataFrame:
    """Extraction by patterns in order of preference, the right-most match of the first that matches."""
    return table(spark, d, "doc").select("id", extraction.first_match(F.col("query"), [r"([0-9]+) (?:coins|stone)", r"([0-9]+)"]).alias("found"))


@query("WITH t AS (SELECT id, lower(query) AS q FROM doc) SELECT id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(q, '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '[ \\t\\n]+'), lambda w: w <> ''), ' ')) AS normal FROM t")
def quiz_normaliser(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc").select("id", F.md5(T.quiz_normal(F.col("query"))).alias("normal"))
