"""Queries: normalised answers, prompts by template, pools of examples, tokenised corpora, shuffled blocks, mask pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from ..operators import extraction, ordering, packing, pairs, sampling, scores
from ..sources import shards
from ..sources.tables import spread, table
from .evaluation import _ANSWERS, _SHARED, answers, written
from .pairing import _HASH, KEY
from .refining import TEXT, WS, distinct_outputs, documents
from .registry import query

_WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> '')"


@query(f"SELECT sha256({TEXT}) AS id, md5(CASE WHEN greatest(1, (length({TEXT}) + 3) // 4) <= 400 THEN {TEXT} ELSE '' END) AS text, source FROM documents")
def adapted_raw_content(spark: SparkSession, d: str) -> DataFrame:
    """Rows with raw content as the adapter makes them: text, hash, and the other columns as a map."""
    rows = table(spark, d, "documents").select(F.col("text").alias("raw_content"), "source")
    return shards.adapted(rows, "redpajama", 400).select("id", F.md5("text").alias("text"), F.col("meta")["source"].alias("source"))


@query(f"SELECT '0' AS id, md5(CASE WHEN len(string_split({TEXT}, chr(10))) <= 20 THEN {TEXT} ELSE '' END) AS text, count(*) AS rows FROM documents GROUP BY ALL")
def adapted_math_text(spark: SparkSession, d: str) -> DataFrame:
    return shards.adapted(table(spark, d, "documents").select("text"), "openwebmath", 20).groupBy("id", F.md5("text").alias("text")).agg(F.count("*").alias("rows"))


@query("SELECT count(*) AS rows FROM documents")
def footer_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of rows, from the files' footers: no column is read."""
    return table(spark, d, "documents").groupBy().count().withColumnRenamed("count", "rows")


@query("WITH p AS (SELECT source_parquet, source_row_index, id, row_number() OVER (PARTITION BY source_parquet, source_row_index ORDER BY ingested_at, id, language_score) AS n, row_number() OVER (PARTITION BY source_parquet, source_row_index ORDER BY ingested_at DESC, id DESC, language_score DESC) AS m FROM crawl_rows) SELECT source_parquet, source_row_index, max(id) FILTER (n = 1) AS first_id, max(id) FILTER (m = 1) AS last_id FROM p GROUP BY ALL")
def first_and_last(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last delivery of each row, by the operator for one row a key."""
    rows = table(spark, d, "crawl_rows").select(*KEY, "id", "ingested_at", "language_score")
    order = ["ingested_at", "id", "language_score"]
    first = ordering.first_by(rows, KEY, [F.col(c) for c in order]).select(*KEY, F.col("id").alias("first_id"))
    # the last one is the first in the order turned round
    last = ordering.last_by(rows, KEY, [F.col(c) for c in order]).select(*KEY, F.col("id").alias("last_id"))
    return first.join(last, KEY)


@query("WITH d AS (SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS i, doc_id, length(coalesce(text, '')) AS n FROM documents), l AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, label FROM embeddings) SELECT doc_id, CAST(n AS BIGINT) AS chars, label FROM d JOIN l USING (i)")
def rows_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Two tables joined row by row, by position in their orders."""
    left = ordering.global_index(documents(spark, d).select("source", "doc_id", F.length("text").cast("bigint").alias("chars")), ["source", "doc_id"])
    right = ordering.global_index(table(spark, d, "embeddings").select("vec_id", "label"), ["vec_id"])
    return left.join(right, "global_index").select("doc_id", "chars", "label")


@query(
    r"""SELECT id, md5(replace(query, ' . ', '.' || chr(10))) AS stops, md5(regexp_replace(regexp_replace('{' || query || '}', '^\{', ''), '\}$', '')) AS braces, CAST(floor(length(query) / 3.5) AS BIGINT) AS budget, md5(replace('x <t>' || query || '</t> y <u>', 'x <t>' || query || '</t> y <u>', 'x  y <u>')) AS tags FROM doc"""
)
def answer_normalisers(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    tagged = F.concat(F.lit("x <t>"), q, F.lit("</t> y <u>"))
    braced = F.concat(F.lit("{"), q, F.lit("}"))
    return table(spark, d, "doc").select(
        "id", F.md5(T.spaced_stops(q)).alias("stops"), F.md5(T.without_braces(braced)).alias("braces"), T.token_budget(F.length(q), 3.5).alias("budget"), F.md5(T.without_tags(tagged, ("<t>", "</t>"), ("<u>", "</u>"))).alias("tags")
    )


@query(
    """WITH c AS (SELECT id, query, choices, rtrim(query) AS q, regexp_matches(rtrim(query), '[.!?:]$') AS ended FROM doc)
    SELECT id, md5(list_reduce(list_prepend('', list_transform(choices, lambda x: ' ' || CASE WHEN ended THEN upper(left(trim(x), 1)) ELSE lower(left(trim(x), 1)) END || substr(trim(x), 2))), lambda a, b: a || '/' || b)) AS goes_on, md5(regexp_replace(q, '[.!?]$', '') || ' because') AS cause,
    md5(regexp_replace(q, '[.!?]$', '') || ', right?') AS entailed, md5(trim(choices[1]) || chr(10) || 'Question: ' || trim(query) || chr(10) || 'Answer:') AS reading, md5('EN: ' || trim(query) || chr(10) || 'DE:') AS translation FROM c"""
)
def template_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Items under the other templates: continuation, cause, entailment, reading, translation."""
    q, c = F.col("query"), F.col("choices")
    _, following = prompts.continuation(q, c)
    because, _ = prompts.cause_or_effect(q, F.lit("cause"), c)
    asked, _ = prompts.entailment(q, F.get(c, F.lit(0)))
    return table(spark, d, "doc").select(
        "id", F.md5(F.array_join(F.concat(F.array(F.lit("")), following), "/")).alias("goes_on"), F.md5(because).alias("cause"), F.md5(asked).alias("entailed"),
        F.md5(prompts.reading_question(F.get(c, F.lit(0)), q)).alias("reading"), F.md5(prompts.translation(q, "en", "de")).alias("translation"),
    )


@query(
    """SELECT id, md5(trim(query) || chr(10) || 'What of the following is the right choice? Explain your answer.' || chr(10) || array_to_string(list_transform(range(len(choices)), lambda i: '(' || chr(CAST(65 + i AS INT)) || ') ' || trim(choices[i + 1])), ', ')) AS explained,
    md5(CASE WHEN right(trim(query), 1) = '.' THEN trim(query) ELSE trim(query) || '.' END || ' ' || trim(choices[1])) AS body, md5(trim(query) || chr(10) || 'Theorem: ' || trim(choices[1])) AS theorem,
    md5('Read the following table regarding "' || task_name || '" and answer a question:' || chr(10) || choices[1] || chr(10) || query) AS of_table, md5(trim(trim(query) || CASE WHEN gold_index[1] = 0 THEN ' (Yes or No)' ELSE '' END)) AS closed FROM doc"""
)
def question_forms(spark: SparkSession, d: str) -> DataFrame:
    """Items as questions of several data sets' forms."""
    q, c, first = F.col("query"), F.col("choices"), F.get("choices", F.lit(0))
    ask = lambda form, **row: F.md5(extraction.question(row, form))
    truth = F.when(F.get("gold_index", F.lit(0)) == 0, "Yes").otherwise("maybe")
    return table(spark, d, "doc").select(
        "id", ask("explained_options", question=q, options=c).alias("explained"), ask("stopped_body", body=q, question=first).alias("body"), ask("theorem", question=q, theorem=first).alias("theorem"),
        ask("table", title=F.col("task_name"), table=first, question=q).alias("of_table"), F.md5(extraction.closed_question(F.trim(q), truth)).alias("closed"),
    )


@query("WITH p AS (SELECT task_name, id, row_number() OVER (PARTITION BY task_name ORDER BY id) AS turn FROM doc), x AS (SELECT d.id, p.id AS example, p.turn FROM doc d JOIN p USING (task_name) WHERE p.turn <= 4 AND p.id <> d.id) SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS place, example FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn) <= 3")
def fewshot_sequential(spark: SparkSession, d: str) -> DataFrame:
    """Three examples for each item: the first of its task in order, without the item itself."""
    items = table(spark, d, "doc").select("task_name", "id")
    return sampling.few_shots(items, sampling.sequential_pool(items, ["id"], 3), "task_name", "id", 3)


@query(f"WITH p AS (SELECT task_name, id, row_number() OVER (PARTITION BY task_name ORDER BY {_HASH(9, 'id')}, id) AS turn FROM doc), x AS (SELECT d.id, p.id AS example, p.turn FROM doc d JOIN p USING (task_name) WHERE p.turn <= 4 AND p.id <> d.id) SELECT id, row_number() OVER (PARTITION BY id ORDER BY turn) - 1 AS place, example FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn) <= 3")
def fewshot_random(spark: SparkSession, d: str) -> DataFrame:
    """The same, drawn by a keyed hash."""
    items = table(spark, d, "doc").select("task_name", "id")
    return sampling.few_shots(items, sampling.random_pool(items, ["id"], 9), "task_name", "id", 3)


@query("SELECT id, CAST((row_number() OVER (ORDER BY id) - 1 - 10 + count(*) OVER ()) % count(*) OVER () AS BIGINT) AS place FROM doc")
def fewshot_rotated(spark: SparkSession, d: str) -> DataFrame:
    """The pool in order, rotated by five examples for seed 2."""
    return sampling.sequential_pool(table(spark, d, "doc").select("id"), ["id"], 5, 2)


def word_ids(texts: list[str]) -> list[list[int]]:
    """A tokenizer for the query: begin token 1, then for each word its length and 3."""
    return [[1, *(len(w) + 3 for w in t.split())] for t in texts]


_TOKENISED = f"SELECT source, doc_id, list_append(list_transform({_WORDS('text')}, lambda w: length(w) + 3), 2) AS ids FROM documents WHERE text <> ''"


@query(f"SELECT doc_id, md5(array_to_string(ids, ',')) AS ids, CAST(len(ids) AS BIGINT) AS tokens FROM ({_TOKENISED})")
def tokenise_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as ids with an end token and without a begin token; empty ones are skipped."""
    own = pairs.tokenised(spread(table(spark, d, "documents").select("doc_id", "text")), "text", word_ids, end=2, begin=1)
    return own.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"), F.size("ids").cast("bigint").alias("tokens"))


@query(f"WITH g AS (SELECT id, row_number() OVER (ORDER BY source, doc_id, i) - 1 AS pos FROM (SELECT source, doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM ({_TOKENISED}))) SELECT pos // 256 AS block, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS ids FROM g GROUP BY 1 HAVING count(*) = 256")
def pack_tokenised(spark: SparkSession, d: str) -> DataFrame:
    """The tokenised corpus in blocks of 256, documents told apart by their end tokens."""
    own = pairs.tokenised(spread(table(spark, d, "documents").select("source", "doc_id", "text")), "text", word_ids, end=2, begin=1)
    blocks = packing.pack_blocks(own, ["source", "doc_id"], "ids", 256)
    return blocks.select("block", F.md5(F.array_join(F.col("block_ids").cast("array<string>"), ",")).alias("ids"))


@query(
    """WITH f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)), b AS (SELECT source, r // 3 AS buffer FROM f WHERE r // 3 < n // 3 UNION ALL SELECT source, n // 3 FROM f WHERE n % 3 > 0 AND n >= 3 AND r < 3 UNION ALL SELECT source, 0 FROM f WHERE n < 3),
    x AS (SELECT source, doc_id, buffer, sha256('4:' || buffer || ':' || source || ':' || doc_id) AS h FROM documents JOIN b USING (source)) SELECT source, doc_id, CAST(buffer AS BIGINT) AS buffer, row_number() OVER (ORDER BY buffer, h, source, doc_id) - 1 AS place FROM x"""
)
def block_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Blocks (here documents) of files (here sources) shuffled within buffers of three files."""
    return sampling.shuffled_blocks(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 3, 4).select("source", "doc_id", "buffer", "place")


@query()
def mask_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of text and character mask of the source rows that are one chunk."""
    once = table(spark, d, "denoise_dataset").groupBy(*KEY, "chunk_index").agg(F.min_by(T.filled(F.col("chunk_body")), "chunk_id").alias("body"))
    bodies = once.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))), lambda x: x["body"]).alias("bodies"))
    joined = bodies.join(distinct_outputs(spark, d).select(*KEY, "programs_delimited"), KEY)
    return pairs.mask_pairs(joined, KEY, "bodies", "programs_delimited").select(*KEY, F.md5("text").alias("text"), F.md5("target").alias("target"))


_CHARS = "regexp_replace({}, '[\\s]+', '', 'g')"
_GRAMS = lambda t, n: f"list_transform(range(greatest(length({t}) - {n - 1}, 0)), lambda i: substr({t}, i + 1, {n}))"


@query(
    f"""WITH {_ANSWERS}, p AS (SELECT {_CHARS.format('golds[1]')} AS a, {_CHARS.format("coalesce(text[1], '')")} AS b FROM t WHERE len(golds) > 0), g AS (SELECT {", ".join(f"{_GRAMS('a', n)} AS a{n}, {_GRAMS('b', n)} AS b{n}" for n in range(1, 7))} FROM p),
    n AS (SELECT count(*) AS rows, {", ".join(f"sum(len(b{n})) AS p{n}, sum(len(a{n})) AS q{n}, sum(coalesce({_SHARED(f'a{n}', f'b{n}')}, 0)) AS h{n}" for n in range(1, 7))} FROM g),
    m AS (SELECT rows, ({" + ".join(f"h{n} / p{n}" for n in range(1, 7))}) / 6 AS precision, ({" + ".join(f"h{n} / q{n}" for n in range(1, 7))}) / 6 AS recall FROM n) SELECT rows, round(100 * 5 * precision * recall / (4 * precision + recall), 6) AS chrf FROM m"""
)
def corpus_chrf(spark: SparkSession, d: str) -> DataFrame:
    rows = written(spark, d).where("size(golds) > 0").select(F.get("golds", F.lit(0)).alias("g"), F.coalesce(F.get("text", F.lit(0)), F.lit("")).alias("p"))
    return extraction.corpus_chrf(rows, "g", "p").select("rows", F.round("chrf", 6).alias("chrf"))


@query()
def reading_comprehension(spark: SparkSession, d: str) -> DataFrame:
    """Exact match and F1 of spans with the number check, and the summary and edit scores, of each answer."""
    rows = written(spark, d).where("size(golds) > 0").select("id", "model", "golds", "text", F.get("golds", F.lit(0)).alias("g"), F.coalesce(F.get("text", F.lit(0)), F.lit("")).alias("p"))
    done = rows.select("id", "model", scores.reading_scores("golds", "text").alias("r"), scores.summary_f1("g", "p").alias("lsum"), scores.edit_similarity("g", "p").alias("alike"), scores.math_equal("g", "p").alias("equal"))
    return done.select("id", "model", "r.exact", "r.f1", F.round("lsum", 6).alias("rouge_lsum"), F.round("alike", 6).alias("edit_similarity"), "equal")


@query(f"WITH {_ANSWERS}, x AS (SELECT model, unnest(logprobs) AS lp FROM s) SELECT model, round(avg(-lp), 6) AS cross_entropy, round(avg(-lp * exp(lp)), 6) AS entropy_terms, count(*) AS positions FROM x GROUP BY model")
def entropy_sums(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy and the entropy's terms over positions with log-probabilities."""
    rows = answers(spark, d).where("logprobs IS NOT NULL AND size(logprobs) = size(choices)")
    return scores.token_entropy(rows, "model", "logprobs").select("model", F.round("cross_entropy", 6).alias("cross_entropy"), F.round("entropy_terms", 6).alias("entropy_terms"), "positions")


@query(
    f"""WITH {_ANSWERS}, c AS (SELECT id, model, task_name, CAST(list_contains(gold_index, list_position(logprobs, list_max(logprobs)) - 1) AS INT) AS acc FROM s), e AS (SELECT model, task_name, CAST(max(CASE WHEN x <> '' AND trim(g) = trim(x) THEN 1 ELSE 0 END) AS INT) AS v FROM (SELECT id, model, task_name, unnest(golds) AS g, x FROM (SELECT id, model, task_name, golds, unnest(text) AS x FROM t)) GROUP BY id, model, task_name)
    SELECT 'acc' AS score, model, task_name, round(avg(acc), 6) AS value, count(*) AS samples FROM c GROUP BY ALL UNION ALL SELECT 'em', model, task_name, round(avg(v), 6), count(*) FROM e GROUP BY ALL"""
)
def scores_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Scores run by their names from the registry, each over the answers it needs."""
    return scores.run_scores(answers(spark, d), ["acc", "em"], ["model", "task_name"]).select("score", "model", "task_name", F.round("value", 6).alias("value"), "samples")


@query("WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id) SELECT user_id, round(c / n, 6) AS avg_n FROM c")
def average_at_n(spark: SparkSession, d: str) -> DataFrame:
    """Mean over samples; a user's events stand in for samples of an item."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("c"))
    return counts.select("user_id", F.round(F.col("c") / F.col("n"), 6).alias("avg_n"))


@query("SELECT doc_id, md5(coalesce(CASE WHEN trim(text) <> '' THEN text END, CASE WHEN trim(url) <> '' THEN url END, '')) AS main FROM documents")
def output_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of output rows by the order in which viewers look for it."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.coalesce("url", F.lit("")).alias("programs_delimited"))
    fallback = T.output_text(rows.select("text", "programs_delimited"))
    return rows.select("doc_id", F.md5(F.when((F.trim("programs_delimited") == "") & (F.coalesce(F.trim("text"), F.lit("")) == ""), "").otherwise(fallback)).alias("main"))


@query("SELECT source_parquet, source_row_index, md5(trim(coalesce(programs_delimited, ''), ' ')) AS target FROM code_output")
def example_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of text and target as a viewer shows them."""
    rows = table(spark, d, "code_output").select(*KEY, F.struct(F.col("programs_delimited").alias("chunk_program")).alias("metadata"), F.lit("").alias("text"))
    _, target = prompts.example_pair(rows)
    return rows.select(*KEY, F.md5(target).alias("target"))


@query("WITH m AS (SELECT model, task_name, avg(acc) AS v FROM (SELECT model, task_name, 1.0 AS acc FROM model_response WHERE logprobs IS NOT NULL) GROUP BY ALL) SELECT model, count(*) AS tasks FROM m GROUP BY model")
def reported_tasks(spark: SparkSession, d: str) -> DataFrame:
    """How many tasks each model has in a report in which missing values are marked."""
    rows = table(spark, d, "model_response").where("logprobs IS NOT NULL").groupBy("model", "task_name").agg(F.lit(1.0).alias("v"))
    wide = scores.with_missing(scores.pivoted(rows, "model", "task_name", "v").drop("average"))
    tasks = [c for c in wide.columns if c != "model"]
    return wide.select("model", F.size(F.filter(F.array(*tasks), lambda x: x != "N/A")).cast("bigint").alias("tasks"))


@query(
    r"""SELECT id, md5(query || ' ' || task_name) AS numbered, gold_index[1] AS gold, md5(array_to_string(list_transform(choices, lambda c: ' ' || c), '|')) AS listed,
    md5(replace(regexp_replace(replace(task_name || ': ' || query || ' ' || upper(left(choices[1], 1)) || lower(substr(choices[1], 2)) || ' ', ' [title]', '. '), '\[[^\]]*\]', '', 'g'), '  ', ' ')) AS ending FROM doc""".replace("\\\\", "\\")
)
def item_forms(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three kinds of data sets made items."""
    q, c, gold = F.col("query"), F.col("choices"), F.get("gold_index", F.lit(0))
    numbered, lettered = prompts.numbered_item(q, F.col("task_name"), c, gold + 1), prompts.lettered_item(q, c, F.char(gold + 65))
    ending = prompts.ending_item(F.col("task_name"), q, F.get(c, F.lit(0)), c, gold.cast("string"))
    rows = table(spark, d, "doc").select("id", numbered.alias("n"), lettered.alias("l"), ending.alias("e"))
    same = F.when((F.col("n.gold_index") == F.col("l.gold_index")) & (F.col("l.gold_index") == F.col("e.gold_index")), F.col("l.gold_index"))
    return rows.select("id", F.md5("n.query").alias("numbered"), same.alias("gold"), F.md5(F.array_join("l.choices", "|")).alias("listed"), F.md5("e.query").alias("ending"))
