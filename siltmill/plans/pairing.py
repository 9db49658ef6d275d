"""Queries: order, shards and caps, joins of inputs and outputs, samples, masks, labels and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ordering, packing, pairs, sampling
from ..sources.tables import spread, table
from .refining import _CHUNKS, _OUTPUTS, TEXT, WS, distinct_outputs, documents, refined_chunks
from .registry import query

KEY = ["source_parquet", "source_row_index"]
_INDEX = "row_number() OVER (ORDER BY source, doc_id) - 1"


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return ordering.global_index(documents(spark, d).select("source", "doc_id", F.length("text").alias("chars")), ["source", "doc_id"])


@query(f"SELECT doc_id, CAST({_INDEX} AS BIGINT) AS global_index FROM documents")
def global_index(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d).select("doc_id", "global_index")


@query(f"SELECT doc_id, CAST(r AS BIGINT) AS shard, CAST(i % 7 AS BIGINT) AS turn, CAST(i // 100 AS BIGINT) AS batch FROM (SELECT doc_id, {_INDEX} AS i, count(*) OVER () AS n FROM documents) JOIN range(7) t(r) ON i >= n * r // 7 AND i < n * (r + 1) // 7")
def row_range_shard(spark: SparkSession, d: str) -> DataFrame:
    """Shards by ranges of rows and in turn, and batches, for 7 readers."""
    rows = F.lit(table(spark, d, "documents").count())  # from the files' footers
    i = F.col("global_index")
    return indexed(spark, d).select("doc_id", ordering.row_range_shard(i, rows, 7).alias("shard"), ordering.round_robin_shard(i, 7).alias("turn"), ordering.batch_number(i, 100).alias("batch"))


@query(f"SELECT doc_id, chars FROM (SELECT doc_id, CAST(length({TEXT}) AS BIGINT) AS chars, sum(length({TEXT})) OVER (ORDER BY source, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) WHERE upto <= 1000000")
def cap_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The documents that fit into a cap of a million characters, in order."""
    sizes = documents(spark, d).select("source", "doc_id", F.length("text").cast("bigint").alias("chars"))
    return ordering.cap_prefix(sizes, ["source", "doc_id"], F.col("chars"), 1_000_000).select("doc_id", "chars")


@query(f"SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length({TEXT})) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 1000000")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    sizes = documents(spark, d).select("source", "doc_id", F.length("text").alias("chars"))
    return ordering.budget_prefix(sizes, ["source", "doc_id"], F.col("chars"), 1_000_000).select("doc_id")


@query(f"SELECT doc_id, md5({TEXT}) AS text FROM documents QUALIFY {_INDEX} = 77")
def nth_document(spark: SparkSession, d: str) -> DataFrame:
    return ordering.nth_row(documents(spark, d).select("source", "doc_id", "text"), ["source", "doc_id"], 77).select("doc_id", F.md5("text").alias("text"))


@query("SELECT source_parquet, source_row_index, c.num_chunks AS num_chunks, r.id IS NOT NULL AS has_source FROM (" + _OUTPUTS + ") c LEFT JOIN (SELECT source_parquet, source_row_index, any_value(id) AS id FROM crawl_rows GROUP BY ALL) r USING (source_parquet, source_row_index)")
def output_sources(spark: SparkSession, d: str) -> DataFrame:
    """Outputs with whether their source row is there (missing ones are counted, not lost)."""
    return pairs.with_misses(distinct_outputs(spark, d), table(spark, d, "crawl_rows"), KEY).select(*KEY, "num_chunks", "has_source")


@query(_CHUNKS + "SELECT chunk_id, md5(body) AS reference, md5(edited) AS output FROM st")
def paired_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunk and edited chunk side by side, joined on the chunk's key."""
    inputs = table(spark, d, "denoise_dataset").select("chunk_id", T.filled(F.col("chunk_body")).alias("chunk_body"))
    return pairs.paired_rows(inputs, refined_chunks(spark, d).select("chunk_id", "edited"), ["chunk_id"], "chunk_body", "edited").select("chunk_id", F.md5("reference").alias("reference"), F.md5("output").alias("output"))


@query("WITH k AS (SELECT dump, source_row_index, source_parquet, dump || '/' || source_parquet || '/' || source_row_index AS mid FROM crawl_rows) SELECT mid, CAST(regexp_extract(mid, '/([0-9]+)$', 1) AS BIGINT) AS row_index, count(*) AS documents FROM k JOIN (SELECT source_parquet AS sp, source_row_index AS ri FROM crawl_rows) c ON c.sp = k.source_parquet AND c.ri = CAST(regexp_extract(mid, '/([0-9]+)$', 1) AS BIGINT) GROUP BY ALL")
def row_key_in_id(spark: SparkSession, d: str) -> DataFrame:
    """Rows without text found again by the row number at the end of their ids."""
    crawl = table(spark, d, "crawl_rows")
    ids = crawl.select(F.concat_ws("/", "dump", "source_parquet", F.col("source_row_index").cast("string")).alias("mid"), F.col("source_parquet").alias("sp"))
    ids = ids.withColumn("row_index", F.regexp_extract("mid", "/([0-9]+)$", 1).cast("bigint"))
    found = ids.join(crawl.select("source_parquet", "source_row_index"), (F.col("sp") == F.col("source_parquet")) & (F.col("row_index") == F.col("source_row_index")))
    return found.groupBy("mid", "row_index").agg(F.count("*").alias("documents"))


@query(
    f"""WITH b AS (SELECT source_parquet, source_row_index, list(body ORDER BY chunk_index) AS bodies FROM (SELECT source_parquet, source_row_index, chunk_index, coalesce(arg_min(coalesce(chunk_body, ''), chunk_id), '') AS body FROM denoise_dataset GROUP BY ALL) GROUP BY ALL),
    j AS (SELECT * FROM b JOIN ({_OUTPUTS}) USING (source_parquet, source_row_index) WHERE len(bodies) = len(programs))
    SELECT source_parquet, source_row_index, CAST(i AS BIGINT) AS chunk, md5(bodies[i + 1]) AS text, md5(programs[i + 1]) AS target FROM (SELECT *, unnest(range(len(bodies))) AS i FROM j)"""
)
def chunk_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunk and program of the source rows where their numbers agree."""
    once = table(spark, d, "denoise_dataset").groupBy(*KEY, "chunk_index").agg(F.min_by(T.filled(F.col("chunk_body")), "chunk_id").alias("body"))
    bodies = once.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))), lambda x: x["body"]).alias("bodies"))
    joined = bodies.join(distinct_outputs(spark, d).select(*KEY, "programs"), KEY)
    return pairs.chunk_pairs(joined, "bodies", "programs").select(*KEY, F.col("chunk").cast("bigint").alias("chunk"), F.md5("text").alias("text"), F.md5("target").alias("target"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Rows not done yet."""
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


_SOURCE_ROW, _SOURCE = "source_parquet || ':' || source_row_index", "source_parquet"
_HASH = lambda seed, key: f"sha256('{seed}:' || {key})"
_SHARE = lambda seed, key: f"(CAST(('0x' || substr(sha256('{seed}:' || {key}), 1, 12)) AS BIGINT) / 281474976710656.0)"


@query(f"SELECT chunk_id, rank_ <= 100 AS is_held FROM denoise_dataset JOIN (SELECT source_parquet, source_row_index, row_number() OVER (ORDER BY {_HASH(42, _SOURCE_ROW)}) AS rank_ FROM (SELECT DISTINCT source_parquet, source_row_index FROM denoise_dataset)) USING (source_parquet, source_row_index)")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    """100 source rows held out with all their chunks."""
    return sampling.hold_out(table(spark, d, "denoise_dataset").select("chunk_id", *KEY), KEY, 42, 100).select("chunk_id", "is_held")


@query(f"SELECT doc_id, CASE WHEN {_SHARE(7, 'doc_id')} < 0.1 THEN 'validation' ELSE 'train' END AS split, CASE WHEN {_SHARE(8, 'doc_id')} < 0.5 THEN 'web' WHEN {_SHARE(8, 'doc_id')} < 0.8 THEN 'code' ELSE 'maths' END AS draw FROM documents")
def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    """Split by ratio, and draws from a weighted mixture."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", sampling.ratio_split(0.1, 7, k).alias("split"), sampling.mixture_draw({"web": 5, "code": 3, "maths": 2}, 8, k).alias("draw"))


@query(f"WITH v AS (SELECT doc_id, arg_max(quality, (labelled_at, quality)) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_HASH(3, 'doc_id')}) AS turn, count(*) OVER (PARTITION BY quality) AS size FROM v) SELECT doc_id, CAST(quality AS BIGINT) AS quality, turn FROM r ORDER BY turn, size DESC, quality LIMIT 20")
def fewshot_balanced(spark: SparkSession, d: str) -> DataFrame:
    verdict = table(spark, d, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max_by("quality", F.struct("labelled_at", "quality")).cast("bigint").alias("quality"))
    return sampling.balanced_pool(verdict, "doc_id", "quality", 3, 20).select("doc_id", "quality", F.col("turn").cast("bigint").alias("turn"))


@query(f"SELECT source_parquet, CAST(row_number() OVER (ORDER BY {_HASH(5, _SOURCE)}) % 4 + 1 AS BIGINT) AS folder FROM (SELECT DISTINCT source_parquet FROM crawl_rows)")
def file_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return sampling.multi_epoch_files(table(spark, d, "crawl_rows").select("source_parquet").distinct(), "source_parquet", 5, 4)


@query(
    _CHUNKS
    + """, c AS (SELECT chunk_id, body, edited FROM st WHERE body <> '' AND edited <> '' AND body <> edited),
    a AS (SELECT chunk_id, ch, count(*) AS n FROM (SELECT chunk_id, unnest(string_split(body, '')) AS ch FROM c) GROUP BY ALL), b AS (SELECT chunk_id, ch, count(*) AS n FROM (SELECT chunk_id, unnest(string_split(edited, '')) AS ch FROM c) GROUP BY ALL),
    s AS (SELECT chunk_id, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (chunk_id, ch) GROUP BY chunk_id)
    SELECT chunk_id, CAST(CASE WHEN body = edited THEN 0 WHEN body = '' OR edited = '' THEN length(body) + length(edited) ELSE length(body) + length(edited) - 2 * coalesce(shared, 0) END AS DOUBLE) AS score FROM st LEFT JOIN s USING (chunk_id) ORDER BY score DESC, chunk_id LIMIT 25"""
)
def dissimilarity_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 25 chunks that their programs changed most."""
    scored = refined_chunks(spark, d).select("chunk_id", pairs.dissimilarity(F.col("chunk_body"), F.col("edited")).alias("score"))
    return ordering.top_rows(scored, "score", "chunk_id", 25)


@query()
def keep_mask(spark: SparkSession, d: str) -> DataFrame:
    """Character masks of edited chunks."""
    # the matcher takes far longer than moving its rows: as many tasks as there are cores, whatever the join came out in
    rows = refined_chunks(spark, d).select("chunk_id", "chunk_body", "edited").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk_id")
    own = pairs.keep_masks(rows, "chunk_id", "chunk_body", "edited")
    return own.select("chunk_id", "chars", F.length(F.replace("mask", F.lit("0"), F.lit(""))).cast("bigint").alias("kept"), F.md5("mask").alias("mask"))


@query()
def inline_diff(spark: SparkSession, d: str) -> DataFrame:
    own = refined_chunks(spark, d).where("status = 'edited'").select("chunk_id", F.explode(pairs.inline_diff("chunk_body", "edited")).alias("s"))
    return own.groupBy("s.tag").agg(F.count("*").alias("steps"))


_WORDS = f"list_filter(regexp_split_to_array({TEXT}, '{WS}'), lambda w: w <> '')"


def word_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their words' lengths, which stand in for token ids."""
    return spread(documents(spark, d).select("source", "doc_id", "text")).select("source", "doc_id", F.transform(T.words(F.col("text")), lambda w: F.length(w)).alias("ids"))


@query(
    f"""WITH o AS (SELECT doc_id, regexp_extract_all({TEXT}, '(?s).{{5}}') AS tokens FROM documents)
    SELECT doc_id, CAST(coalesce(list_sum(list_transform(range(len(tokens)), lambda i: CASE WHEN (3 - i * 5 % 11 + 11) % 11 < 5 THEN 0 ELSE 1 END)), 0) AS BIGINT) AS kept, CAST(len(tokens) AS BIGINT) AS tokens,
    md5(array_to_string(list_transform(list_filter(range(len(tokens)), lambda i: i * 5 % 3 > 0), lambda i: tokens[i + 1]), '')) AS rebuilt FROM o"""
)
def token_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of tokens (here five characters each) from a character mask, and the text rebuilt from the kept ones."""
    t, n = F.col("text"), F.length("text")
    count = F.floor(n / 5).cast("int")
    own = documents(spark, d).select("doc_id", "text").withColumn("mask", F.substring(F.expr("repeat('11101111111', CAST(length(text) / 11 AS INT) + 1)"), F.lit(1), n))
    own = own.withColumn("starts", F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: i * 5))
    own = own.withColumn("ends", F.transform("starts", lambda s: s + 5)).withColumn("scores", F.transform("starts", lambda s: (s % 3).cast("double")))
    labels = pairs.token_labels("starts", "ends", "mask", n)
    rebuilt = pairs.kept_tokens(t, "starts", "ends", "scores", F.lit(0.0))
    done = own.select("doc_id", labels.alias("labels"), F.size("starts").cast("bigint").alias("tokens"), F.md5(rebuilt).alias("rebuilt"))
    return done.select("doc_id", F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("kept"), "tokens", "rebuilt")


@query(
    f"""WITH w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: length(x)) AS ids FROM documents), p AS (SELECT doc_id, list_slice(ids, 1, 10) AS prompt, list_slice(ids, 11, len(ids)) AS target FROM w),
    e AS (SELECT doc_id, list_concat(prompt, target) AS ids, list_concat(list_transform(prompt, lambda x: -100), target) AS labels FROM p), l AS (SELECT doc_id, list_slice(ids, -40, -1) AS ids, list_slice(labels, -40, -1) AS labels FROM e)
    SELECT doc_id, md5(array_to_string(ids, ',')) AS ids, CAST(len(list_filter(labels, lambda x: x <> -100)) AS BIGINT) AS supervised, md5(array_to_string(list_concat(ids, list_transform(range(48 - len(ids)), lambda i: 0)), ',')) AS padded FROM l"""
)
def causal_labels(spark: SparkSession, d: str) -> DataFrame:
    own = word_lengths(spark, d).select("doc_id", F.slice("ids", 1, 10).alias("prompt"), F.slice("ids", F.lit(11), F.size("ids")).alias("target"))
    ids, labels = pairs.causal_example(F.col("prompt"), F.col("target"), 40)
    text = lambda x: F.md5(F.array_join(x.cast("array<string>"), ","))
    return own.select("doc_id", text(ids).alias("ids"), F.size(F.filter(labels, lambda x: x != pairs.IGNORED)).cast("bigint").alias("supervised"), text(pairs.padded(ids, F.lit(48), 0)).alias("padded"))


@query(
    f"""WITH t AS (SELECT source, doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM (SELECT source, doc_id, list_transform({_WORDS}, lambda x: length(x)) AS ids FROM documents)), g AS (SELECT id, row_number() OVER (ORDER BY source, doc_id, i) - 1 AS pos FROM t)
    SELECT pos // 512 AS block, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS ids FROM g GROUP BY 1 HAVING count(*) = 512"""
)
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = packing.pack_blocks(word_lengths(spark, d), ["source", "doc_id"], "ids", 512)
    return blocks.select("block", F.md5(F.array_join(F.col("block_ids").cast("array<string>"), ",")).alias("ids"))


@query(f"WITH w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: length(x)) AS ids FROM documents) SELECT doc_id, CAST(i AS BIGINT) AS part, md5(array_to_string(list_slice(ids, i * 64 + 1, i * 64 + 64), ',')) AS x, md5(array_to_string(list_slice(ids, i * 64 + 2, i * 64 + 65), ',')) AS y FROM (SELECT *, unnest(range(greatest(len(ids) - 1, 0) // 64)) AS i FROM w)")
def lm_sequences(spark: SparkSession, d: str) -> DataFrame:
    own = word_lengths(spark, d).select("doc_id", F.posexplode(packing.sequences(F.col("ids"), 64)).alias("part", "s"))
    text = lambda x: F.md5(F.array_join(F.col(x).cast("array<string>"), ","))
    return own.select("doc_id", F.col("part").cast("bigint").alias("part"), text("s.x").alias("x"), text("s.y").alias("y"))


@query(
    """WITH l AS (SELECT source_parquet, source_row_index, list(length(coalesce(chunk_body, '')) % 4 ORDER BY chunk_id) AS n FROM denoise_dataset GROUP BY ALL), c AS (SELECT *, list_prepend(0, list_transform(range(len(n)), lambda i: list_sum(list_slice(n, 1, i + 1)))) AS cum FROM l)
    SELECT source_parquet, source_row_index, array_to_string(list_transform(cum, lambda x: CAST(x AS BIGINT)), ',') AS cum, CAST(list_sum(n) AS BIGINT) AS total, coalesce(CAST(list_sum(list_transform(n, lambda x: x * (x - 1) // 2)) AS BIGINT), 0) AS position_sum,
    CAST(coalesce(list_max(list_transform(range(len(n)), lambda i: CASE WHEN n[i + 1] <> 1 THEN i + 1 ELSE 0 END)), 0) AS BIGINT) AS without_tail FROM c"""
)
def cu_seqlens(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "denoise_dataset").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("chunk_id", (F.length(T.filled(F.col("chunk_body"))) % 4).alias("n")))).alias("x")).select(*KEY, F.transform("x", lambda x: x["n"]).alias("n"))
    own = own.withColumn("c", packing.cumulative_lengths(F.col("n")))
    total = F.aggregate(packing.lengths_of(F.col("c")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    positions = F.aggregate(packing.position_ids(F.col("n")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return own.select(*KEY, F.array_join(F.col("c").cast("array<string>"), ",").alias("cum"), total.alias("total"), positions.alias("position_sum"), F.size(packing.without_tail(F.col("n"))).cast("bigint").alias("without_tail"))


@query("WITH r AS (SELECT task_name, id, row_number() OVER (PARTITION BY task_name ORDER BY length(query) DESC, id) - 1 AS place, count(*) OVER (PARTITION BY task_name) AS n FROM doc) SELECT id, place, CAST(floor(place / ceil(n / 4.0)) AS BIGINT) AS bucket FROM r")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return packing.length_buckets(table(spark, d, "doc").select("task_name", "id", "query"), "task_name", "id", F.length("query"), 4).select("id", "place", "bucket")


@query("SELECT id, CAST(dense_rank() OVER (ORDER BY num_samples, len(choices)) AS BIGINT) AS group_no, row_number() OVER (ORDER BY num_samples, len(choices), -length(query), id) AS place FROM doc")
def generation_groups(spark: SparkSession, d: str) -> DataFrame:
    """Items by what they must be generated with (the group) and then by falling length. Both numbers are taken over range partitions."""
    own = table(spark, d, "doc").select("id", "num_samples", F.size("choices").alias("n"), (-F.length("query")).alias("shorter"))
    groups = ordering.global_index(own.select("num_samples", "n").distinct(), ["num_samples", "n"]).withColumnRenamed("global_index", "g")
    placed = ordering.global_index(own, ["num_samples", "n", "shorter", "id"])
    # nulls are equal here, as they are in an order
    same = F.col("p.num_samples").eqNullSafe(F.col("k.num_samples")) & F.col("p.n").eqNullSafe(F.col("k.n"))
    return placed.alias("p").join(groups.alias("k"), same).select("id", (F.col("g") + 1).alias("group_no"), (F.col("global_index") + 1).alias("place"))


@query(f"SELECT doc_id, CAST(i % 7 AS BIGINT) AS replica, CAST(CASE WHEN i = n - 1 THEN 1 + (7 - n % 7) % 7 ELSE 1 END AS BIGINT) AS reads FROM (SELECT doc_id, {_INDEX} AS i, count(*) OVER () AS n FROM documents)")
def sampler_replicas(spark: SparkSession, d: str) -> DataFrame:
    replica, reads = packing.sampler_rows(F.col("global_index"), F.lit(table(spark, d, "documents").count()), 7)
    return indexed(spark, d).select("doc_id", replica.alias("replica"), reads.alias("reads"))


@query(
    f"""WITH RECURSIVE i AS (SELECT doc_id, length({TEXT}) AS n, {_INDEX} AS i FROM documents), o AS (SELECT CAST(i // 64 AS BIGINT) AS batch, doc_id, n, row_number() OVER (PARTITION BY i // 64 ORDER BY n DESC, doc_id) AS k FROM i),
    f AS (SELECT DISTINCT batch, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS doc_id, CAST(-1 AS BIGINT) AS bin, [CAST(0 AS BIGINT), 0, 0, 0] AS s FROM o
      UNION ALL SELECT batch, k, doc_id, bin, list_transform(range(4), lambda j: s[j + 1] + CASE WHEN j = bin THEN n * n ELSE 0 END) FROM (SELECT f.batch, o.k, o.doc_id, list_position(f.s, list_min(f.s)) - 1 AS bin, f.s, o.n FROM f JOIN o ON o.batch = f.batch AND o.k = f.k + 1))
    SELECT batch, doc_id, CAST(bin AS BIGINT) AS bin FROM f WHERE k > 0"""
)
def load_balance(spark: SparkSession, d: str) -> DataFrame:
    """Documents of batches of 64 dealt to 4 bins with even sums of squared lengths."""
    own = indexed(spark, d).select("doc_id", F.floor(F.col("global_index") / 64).alias("batch"), F.col("chars").alias("length"))
    dealt = packing.balance(own, "batch", "doc_id", "length", 4)
    return dealt.select("batch", "doc_id", "bin")


@query(
    f"""WITH w AS (SELECT source, doc_id, list_transform({_WORDS}, lambda x: length(x)) AS ids FROM documents), g AS (SELECT source, doc_id // 8 AS grp, list(ids ORDER BY doc_id) AS a FROM w GROUP BY ALL),
    f AS (SELECT source, grp, flatten(list_transform(range(len(a)), lambda i: CASE WHEN i = 0 THEN a[1] ELSE list_prepend(99, a[i + 1]) END)) AS ids FROM g) SELECT source, grp, md5(array_to_string(list_slice(ids, 1, 60), ',')) AS ids, CAST(len(list_slice(ids, 1, 60)) AS BIGINT) AS size FROM f"""
)
def pack_batch(spark: SparkSession, d: str) -> DataFrame:
    """Examples of a batch in one row, with separators."""
    batches = word_lengths(spark, d).groupBy("source", F.floor(F.col("doc_id") / 8).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "ids"))).alias("x"))
    packed = packing.packed_row(F.transform("x", lambda e: F.struct(e["ids"].alias("ids"), e["ids"].alias("labels"))), 99, 60)
    return batches.select("source", "grp", packed.alias("p")).select("source", "grp", F.md5(F.array_join(F.col("p.ids").cast("array<string>"), ",")).alias("ids"), F.size("p.ids").cast("bigint").alias("size"))
