"""Queries: documents, lines, programs, refinement and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, models, ordering, pipelines, programs
from ..sources.tables import spread, table
from .registry import query

#: White space and line ends for the oracle's regular expressions.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORDS = lambda x: f"CAST(len(list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> '')) AS BIGINT)"
TEXT = "coalesce(text, '')"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents with null texts as empty ones."""
    return table(spark, d, "documents").withColumn("text", T.filled(F.col("text")))


@query(f"SELECT doc_id, source, CAST(length({TEXT}) AS BIGINT) AS chars, sha256({TEXT}) AS content_id FROM documents")
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "source", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("content_id"))


@query(f"SELECT doc_id, CASE WHEN len(string_split({TEXT}, chr(10))) <= 20 THEN md5({TEXT}) ELSE md5('') END AS kept FROM documents")
def adapter_line_limit(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.size(T.lines(F.col("text"))) <= 20, F.col("text")).otherwise("")
    return documents(spark, d).select("doc_id", F.md5(kept).alias("kept"))


@query(f"SELECT doc_id, CASE WHEN greatest(1, (length({TEXT}) + 3) // 4) <= 400 THEN md5({TEXT}) ELSE md5('') END AS kept, sha256({TEXT}) AS id FROM documents")
def adapter_token_limit(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(T.token_estimate(F.col("text")) <= 400, F.col("text")).otherwise("")
    return documents(spark, d).select("doc_id", F.md5(kept).alias("kept"), F.sha2("text", 256).alias("id"))


@query("SELECT doc_id, md5(coalesce(CASE WHEN trim(text) <> '' THEN text END, CASE WHEN trim(url) <> '' THEN url END, CASE WHEN trim(id) <> '' THEN id END, '')) AS main_text FROM documents")
def text_fallback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.first_filled(F.col("text"), F.col("url"), F.col("id"))).alias("main_text"))


@query(
    f"""SELECT doc_id, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS lines, {WORDS('t')} AS words,
    CAST(greatest(1, (length(t) + 3) // 4) AS BIGINT) AS tokens FROM (SELECT doc_id, {TEXT} AS t, regexp_split_to_array({TEXT}, '{ENDS}') AS parts FROM documents)"""
)
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", T.line_count(t).alias("lines"), T.word_count(t).alias("words"), T.token_estimate(t).alias("tokens"))


@query(
    f"""SELECT doc_id, CAST(i AS BIGINT) AS line_no, md5('[' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || ']' || line) AS labelled
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS l FROM documents))"""
)
def label_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(T.labelled_lines(F.col("text"))).alias("n", "line")).select("doc_id", F.col("n").cast("bigint").alias("line_no"), F.md5("line").alias("labelled"))


@query("SELECT source, count(*) AS rows, CAST(count(text) AS BIGINT) AS texts FROM documents GROUP BY source")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.count("text").alias("texts"))


_VERDICT = "SELECT doc_id, arg_max(quality, (labelled_at, quality)) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id"


@query(f"SELECT d.doc_id, CAST(CASE WHEN v.quality = 0 THEN 0 ELSE length({TEXT}) END AS BIGINT) AS chars FROM documents d JOIN ({_VERDICT}) v USING (doc_id)")
def document_program_drop(spark: SparkSession, d: str) -> DataFrame:
    """The document-level program: the last verdict of quality 0 drops the document."""
    verdict = table(spark, d, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max_by("quality", F.struct("labelled_at", "quality")).alias("quality"))
    program = F.when(F.col("quality") == 0, "drop_doc()").otherwise("keep_doc()")
    joined = documents(spark, d).join(verdict, "doc_id")
    return joined.select("doc_id", F.length(programs.document_program(F.col("text"), program)).cast("bigint").alias("chars"))


def refined_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents refined by the rule model's programs."""
    own = models.with_rule_program(spread(documents(spark, d).select("doc_id", "text")), "text", "program")
    return programs.accept(programs.execute(own, "text", "program"), "text")


# The oracle works on lines and knows nothing of programs.
_REFINED = f"""
WITH l AS (SELECT doc_id, text, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT doc_id, {TEXT} AS text, string_split({TEXT}, chr(10)) AS a FROM documents)),
m AS (SELECT *, (trim(line) <> '' AND row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1) OR regexp_full_match(line, 'https?://[^ ]*') AS gone FROM l),
e AS (SELECT doc_id, any_value(text) AS text, count(*) FILTER (gone) AS removed, coalesce(string_agg(replace(line, '  ', ' '), chr(10) ORDER BY i) FILTER (NOT gone), '') AS edited FROM m GROUP BY doc_id),
w AS (SELECT *, {WORDS('text')} AS before, {WORDS('edited')} AS after FROM e),
r AS (SELECT *, CASE WHEN before = 0 THEN 'empty_input' WHEN after / before <= 1 - 0.95 THEN 'dropped' WHEN after <= 10 THEN 'too_short' ELSE 'edited' END AS status FROM w),
refined_rows AS (SELECT *, CASE WHEN status = 'edited' THEN edited ELSE '' END AS refined FROM r)
"""


@query(_REFINED + "SELECT doc_id, CAST(removed AS BIGINT) AS removed_lines, CAST(0 AS BIGINT) AS errors, status, md5(refined) AS refined FROM refined_rows")
def refine_documents(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: program of each document, parsed, executed and accepted or not."""
    return refined_documents(spark, d).select("doc_id", "removed_lines", "errors", "status", F.md5("refined").alias("refined"))


_STATS_SQL = f"""SELECT count(*) AS documents, CAST(sum(greatest(1, (length(text) + 3) // 4)) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN refined = '' THEN 0 ELSE greatest(1, (length(refined) + 3) // 4) END) AS BIGINT) AS output_tokens,
CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS input_lines, CAST(sum(CASE WHEN refined = '' THEN 0 ELSE len(string_split(refined, chr(10))) END) AS BIGINT) AS output_lines, CAST(count(*) FILTER (refined = '') AS BIGINT) AS dropped_empty FROM refined_rows"""


def refinement_statistics(rows: DataFrame) -> DataFrame:
    """Documents, tokens and lines before and after, and texts that came out empty."""
    empty = F.col("refined") == ""
    return rows.agg(
        F.count("*").alias("documents"), F.sum(T.token_estimate(F.col("text"))).alias("input_tokens"), F.sum(F.when(empty, 0).otherwise(T.token_estimate(F.col("refined")))).cast("bigint").alias("output_tokens"),
        F.sum(F.size(T.lines(F.col("text")))).alias("input_lines"), F.sum(F.when(empty, 0).otherwise(F.size(T.lines(F.col("refined"))))).alias("output_lines"), F.count_if(empty).alias("dropped_empty"),
    )


@query(_REFINED + f"SELECT *, greatest(0, input_tokens - output_tokens) AS tokens_removed_net, greatest(0, input_lines - output_lines) AS lines_removed_net FROM ({_STATS_SQL})")
def refine_statistics(spark: SparkSession, d: str) -> DataFrame:
    done = refinement_statistics(refined_documents(spark, d))
    net = lambda a, b: F.greatest(F.lit(0), F.col(a) - F.col(b)).cast("bigint")
    return done.select("*", net("input_tokens", "output_tokens").alias("tokens_removed_net"), net("input_lines", "output_lines").alias("lines_removed_net"))


@query(
    """SELECT run_id, count(*) AS ranks, CAST(sum(documents) AS BIGINT) AS documents, CAST(greatest(0, sum(input_tokens) - sum(output_tokens)) AS BIGINT) AS tokens_removed_net,
    CAST(greatest(0, sum(input_lines) - sum(output_lines)) AS BIGINT) AS lines_removed_net, CAST(sum(documents_dropped_empty) AS BIGINT) AS dropped_empty, max(wall_seconds_total) AS wall_seconds, max(total_split) - count(DISTINCT rank) AS missing_ranks
    FROM rank_stats GROUP BY run_id"""
)
def rank_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the ranks of a run, net figures from the summed totals, and the slowest rank's time."""
    net = lambda a, b: F.greatest(F.lit(0), F.sum(a) - F.sum(b)).cast("bigint")
    return table(spark, d, "rank_stats").groupBy("run_id").agg(
        F.count("*").alias("ranks"), F.sum("documents").alias("documents"), net("input_tokens", "output_tokens").alias("tokens_removed_net"), net("input_lines", "output_lines").alias("lines_removed_net"),
        F.sum("documents_dropped_empty").alias("dropped_empty"), F.max("wall_seconds_total").alias("wall_seconds"), (F.max("total_split") - F.count_distinct("rank")).cast("bigint").alias("missing_ranks"),
    )


def distinct_outputs(spark: SparkSession, d: str) -> DataFrame:
    """code_output with one row for each source row: the longest of those that come twice."""
    return table(spark, d, "code_output").groupBy("source_parquet", "source_row_index").agg(F.max_by(F.struct("num_chunks", "programs", "programs_delimited"), F.struct(F.length("programs_delimited"), "programs_delimited")).alias("o")).select("source_parquet", "source_row_index", "o.*")


_OUTPUTS = "SELECT source_parquet, source_row_index, o.num_chunks AS num_chunks, o.programs AS programs, o.programs_delimited AS programs_delimited FROM (SELECT source_parquet, source_row_index, arg_max(struct_pack(num_chunks := num_chunks, programs := programs, programs_delimited := programs_delimited), (length(programs_delimited), programs_delimited)) AS o FROM code_output GROUP BY ALL)"

# Parsing in the oracle: one row a program line, string functions only.
_PARSED = rf"""
lines AS (SELECT *, unnest(a) AS line, unnest(range(len(a))) AS pos FROM (SELECT *, string_split(trim(program, ' '), chr(10)) AS a FROM programs_in)),
cut AS (SELECT *, instr(line, '(') AS o, instr(line, ')') AS c, starts_with(line, 'remove_lines') AS rm, starts_with(line, 'normalize') AS nz, contains(line, 'all=True') AND starts_with(line, 'remove_lines') AS everything FROM lines),
inn AS (SELECT *, string_split(substr(line, o + 1, greatest((CASE WHEN c > 0 THEN c ELSE length(line) END) - o - 1, 0)), ',') AS parts, CASE WHEN c = 0 THEN 1 ELSE 0 END AS unclosed FROM cut),
val AS (SELECT *, string_split(parts[1], '=')[2] AS one, string_split(parts[2], '=')[2] AS two, len(parts) AS n FROM inn),
num AS (SELECT *, CASE WHEN regexp_full_match(trim(one), '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace(trim(one), '_', '') AS BIGINT) END AS s, CASE WHEN regexp_full_match(trim(two), '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace(trim(two), '_', '') AS BIGINT) END AS e FROM val),
ops AS (SELECT *, CASE WHEN everything THEN 'all' WHEN (rm OR nz) AND o = 0 THEN 'error' WHEN rm AND s IS NOT NULL AND e IS NOT NULL THEN 'remove' WHEN rm THEN 'error'
  WHEN nz AND n = 1 AND one IS NOT NULL THEN 'delete' WHEN nz AND n = 2 AND one IS NOT NULL AND two IS NOT NULL THEN 'replace' WHEN nz AND n <= 2 THEN 'error' ELSE 'other' END AS kind,
  CASE WHEN everything THEN 0 WHEN (rm OR nz) AND o = 0 THEN 1 WHEN rm AND s IS NOT NULL AND e IS NOT NULL THEN unclosed WHEN rm THEN unclosed + 1
  WHEN nz AND n <= 2 AND one IS NOT NULL AND (n = 1 OR two IS NOT NULL) THEN unclosed WHEN nz AND n <= 2 THEN unclosed + 1 WHEN nz THEN unclosed ELSE 0 END AS errs FROM num)
"""


@query(
    f"WITH programs_in AS (SELECT source_parquet, source_row_index, CAST(chunk AS BIGINT) AS chunk, coalesce(p, '') AS program FROM (SELECT *, unnest(programs) AS p, unnest(range(len(programs))) AS chunk FROM ({_OUTPUTS}))), {_PARSED} "
    "SELECT kind, count(*) AS ops, CAST(sum(errs) AS BIGINT) AS errors, CAST(sum(CASE WHEN kind = 'remove' THEN s END) AS BIGINT) AS starts, CAST(sum(CASE WHEN kind = 'remove' THEN e END) AS BIGINT) AS ends FROM ops GROUP BY kind"
)
def program_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every program of code_output, parsed, by kind."""
    own = distinct_outputs(spark, d).select(F.explode("programs").alias("program"))
    ops = own.select(F.explode(programs.parse_program(F.col("program"))).alias("o")).select("o.*")
    return ops.groupBy("kind").agg(F.count("*").alias("ops"), F.sum("errors").alias("errors"), F.sum("first").alias("starts"), F.sum("last").alias("ends"))


def refined_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with the programs that code_output has for them, executed and accepted or not."""
    chunks = table(spark, d, "denoise_dataset").select("chunk_id", "source_parquet", "source_row_index", "chunk_index", T.filled(F.col("chunk_body")).alias("chunk_body"))
    own = distinct_outputs(spark, d).select("source_parquet", "source_row_index", F.posexplode("programs").alias("chunk_index", "program"))
    joined = chunks.join(own, ["source_parquet", "source_row_index", "chunk_index"])
    return programs.accept(programs.execute(joined, "chunk_body", "program"), "chunk_body")


_CHUNKS = f"""WITH programs_in AS (SELECT chunk_id, coalesce(chunk_body, '') AS body, coalesce(p, '') AS program FROM denoise_dataset JOIN (SELECT *, unnest(programs) AS p, unnest(range(len(programs))) AS chunk_index FROM ({_OUTPUTS})) USING (source_parquet, source_row_index, chunk_index)), {_PARSED},
sub AS (SELECT chunk_id, any_value(body) AS body, coalesce(list(unq1 || chr(1) || unq2 ORDER BY pos) FILTER (kind IN ('delete', 'replace') AND unq1 <> '' AND NOT (kind = 'replace' AND unq1 = ' ')), []) AS subs, CAST(sum(errs) AS BIGINT) AS own_errors, bool_or(kind = 'all') AS everything
  FROM (SELECT *, trim(one, '"') AS unq1, CASE WHEN kind = 'replace' THEN trim(two, '"') ELSE '' END AS unq2 FROM ops) GROUP BY chunk_id),
rep AS (SELECT *, string_split(list_reduce(list_prepend(body, subs), lambda t, x: replace(t, string_split(x, chr(1))[1], string_split(x, chr(1))[2])), chr(10)) AS l FROM sub),
iv AS (SELECT chunk_id, s, e, pos FROM ops WHERE kind = 'remove'),
isl AS (SELECT *, CASE WHEN s <= max(e) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM iv WINDOW w AS (PARTITION BY chunk_id ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk_id ORDER BY s, pos) AS g FROM isl),
mrg AS (SELECT chunk_id, g, min(s) AS s, max(e) AS e FROM grp GROUP BY chunk_id, g),
bey AS (SELECT m.chunk_id, count(*) AS beyond FROM mrg m JOIN rep r USING (chunk_id) WHERE m.s >= len(r.l) OR m.e >= len(r.l) GROUP BY m.chunk_id),
gone AS (SELECT DISTINCT chunk_id, unnest(range(greatest(s, 0), least(e, 100000) + 1)) AS i FROM iv WHERE e >= s),
ln AS (SELECT chunk_id, everything, unnest(l) AS line, unnest(range(len(l))) AS i FROM rep),
kept AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY i) AS edited, count(*) AS n FROM ln WHERE NOT everything AND (chunk_id, i) NOT IN (SELECT chunk_id, i FROM gone) GROUP BY chunk_id),
res AS (SELECT chunk_id, body, own_errors + coalesce(beyond, 0) AS errors, len(l) - coalesce(n, 0) AS removed, coalesce(edited, '') AS edited FROM rep LEFT JOIN bey USING (chunk_id) LEFT JOIN kept USING (chunk_id)),
wc AS (SELECT *, {WORDS('body')} AS before, {WORDS('edited')} AS after FROM res),
st AS (SELECT *, CASE WHEN before = 0 THEN 'empty_input' WHEN after / before <= 1 - 0.95 AND errors < 2 THEN 'dropped' WHEN after <= 10 THEN 'too_short' WHEN errors < 2 THEN 'edited' ELSE 'original' END AS status FROM wc)
"""


@query(_CHUNKS + "SELECT chunk_id, CAST(removed AS BIGINT) AS removed_lines, CAST(errors AS BIGINT) AS errors, status, md5(CASE status WHEN 'edited' THEN edited WHEN 'original' THEN body ELSE '' END) AS refined FROM st")
def refine_chunks(spark: SparkSession, d: str) -> DataFrame:
    return refined_chunks(spark, d).select("chunk_id", "removed_lines", "errors", "status", F.md5("refined").alias("refined"))


@query(
    _CHUNKS
    + """, rl AS (SELECT chunk_id, string_agg(line, chr(10) ORDER BY i) AS removed FROM ln WHERE everything OR (chunk_id, i) IN (SELECT chunk_id, i FROM gone) GROUP BY chunk_id), rs AS (SELECT chunk_id, count(*) AS replaced FROM ops WHERE kind IN ('delete', 'replace') GROUP BY chunk_id)
    SELECT chunk_id, md5(coalesce(removed, '')) AS removed, CAST(coalesce(replaced, 0) AS BIGINT) AS replaced FROM rep LEFT JOIN rl USING (chunk_id) LEFT JOIN rs USING (chunk_id)"""
)
def removal_report(spark: SparkSession, d: str) -> DataFrame:
    """What the programs took out of each chunk, and how many replacements they asked for."""
    return refined_chunks(spark, d).select("chunk_id", F.md5(F.array_join("removed", "\n")).alias("removed"), F.size("replaced").cast("bigint").alias("replaced"))


@query(_CHUNKS + "SELECT chunk_id, CAST(s AS BIGINT) AS first_line, CAST(e AS BIGINT) AS last_line FROM mrg")
def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return refined_chunks(spark, d).select("chunk_id", F.explode("merged").alias("m")).select("chunk_id", F.col("m.first").alias("first_line"), F.col("m.last").alias("last_line"))


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, list_transform(range(len(a)), lambda i: greatest(1, (length('[' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || ']' || a[i + 1]) + 3) // 4)) AS t FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS a FROM documents)),
    f AS (SELECT doc_id, t, 1 AS n, 0 AS first, t[1] AS tok, CAST(0 AS BIGINT) AS chunk FROM l
      UNION ALL SELECT doc_id, t, n + 1, CASE WHEN tok + t[n + 1] <= 200 AND tok <= 200 THEN first ELSE n END, CASE WHEN tok + t[n + 1] <= 200 AND tok <= 200 THEN tok + t[n + 1] ELSE t[n + 1] END, CASE WHEN tok + t[n + 1] <= 200 AND tok <= 200 THEN chunk ELSE chunk + 1 END FROM f WHERE n < len(t))
    SELECT doc_id, chunk, CAST(first AS BIGINT) AS first_line, CAST(max(n) - 1 AS BIGINT) AS last_line, CAST(max(tok) AS BIGINT) AS chunk_tokens FROM f GROUP BY doc_id, chunk, first"""
)
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    done = chunking.chunk_lines(spread(documents(spark, d).select("doc_id", "text")), "text", 200)
    return done.select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("chunk", "first_line", "last_line", "chunk_tokens")))


@query(
    rf"""WITH RECURSIVE f AS (SELECT doc_id, {TEXT} AS text, 0 AS start, CAST(-1 AS BIGINT) AS chunk, '' AS piece FROM documents
      UNION ALL SELECT doc_id, text, start + length(piece), chunk + 1, piece FROM (SELECT doc_id, text, start, chunk, CASE WHEN start + 1000 >= length(text) THEN substr(text, start + 1) WHEN contains(substr(text, start + 501, 500), chr(10)) THEN substr(text, start + 1, 500 + length(regexp_extract(substr(text, start + 501, 500), '(?s)^.*\n'))) ELSE substr(text, start + 1, 1000) END AS piece FROM f WHERE start < length(text)))
    SELECT doc_id, chunk, CAST(length(piece) AS BIGINT) AS chars, md5(piece) AS chunk_text FROM f WHERE chunk >= 0"""
)
def chunk_characters(spark: SparkSession, d: str) -> DataFrame:
    done = chunking.chunk_characters(spread(documents(spark, d).select("doc_id", "text")), "text", 1_000)
    return done.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), (F.col("end") - F.col("start")).cast("bigint").alias("chars"), F.md5("chunk_text").alias("chunk_text"))


@query(
    """SELECT source_parquet, source_row_index, count(*) AS parts, md5(string_agg(body, chr(10) ORDER BY chunk_index, body)) AS joined
    FROM (SELECT source_parquet, source_row_index, chunk_index, coalesce(arg_min(coalesce(chunk_body, ''), chunk_id), '') AS body FROM denoise_dataset GROUP BY ALL) GROUP BY ALL"""
)
def gather_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Source rows put together again from the first delivery of each of their chunks."""
    key = ["source_parquet", "source_row_index"]
    once = table(spark, d, "denoise_dataset").groupBy(*key, "chunk_index").agg(F.min_by(T.filled(F.col("chunk_body")), "chunk_id").alias("body"))
    return chunking.gather(once, key, "chunk_index", "body").select(*key, "parts", F.md5("joined").alias("joined"))


_SPANS = f"""WITH RECURSIVE l AS (SELECT doc_id, list_transform(range(len(a)), lambda i: greatest(1, (length('[' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || ']' || a[i + 1]) + 3) // 4)) AS t FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS a FROM documents)),
    f AS (SELECT doc_id, t, 1 AS n, t[1] AS tok, CAST(0 AS BIGINT) AS chunk FROM l
      UNION ALL SELECT doc_id, t, n + 1, CASE WHEN tok + t[n + 1] <= 200 AND tok <= 200 THEN tok + t[n + 1] ELSE t[n + 1] END, CASE WHEN tok + t[n + 1] <= 200 AND tok <= 200 THEN chunk ELSE chunk + 1 END FROM f WHERE n < len(t)),
    c AS (SELECT doc_id, n - 1 AS i, chunk FROM f)"""


@query(
    f"""{_SPANS}, x AS (SELECT doc_id, text, i, line, chunk FROM (SELECT doc_id, {TEXT} AS text, unnest(string_split({TEXT}, chr(10))) AS line, unnest(range(len(string_split({TEXT}, chr(10))))) AS i FROM documents) JOIN c USING (doc_id, i)),
    m AS (SELECT *, (trim(line, ' ') <> '' AND row_number() OVER (PARTITION BY doc_id, chunk, line ORDER BY i) > 1) OR regexp_full_match(line, 'https?://[^ ]*') AS gone FROM x),
    b AS (SELECT doc_id, count(*) FILTER (d) AS k FROM (SELECT doc_id, chunk, bool_or(contains(line, '  ')) AS d FROM x GROUP BY ALL) GROUP BY doc_id),
    e AS (SELECT doc_id, any_value(text) AS text, max(chunk) + 1 AS chunks, count(*) FILTER (gone) AS removed, coalesce(string_agg(list_reduce(list_prepend(line, list_transform(range(k), lambda z: '')), lambda t, z: replace(t, '  ', ' ')), chr(10) ORDER BY i) FILTER (NOT gone), '') AS edited FROM m JOIN b USING (doc_id) GROUP BY doc_id),
    w AS (SELECT *, {WORDS('text')} AS before, {WORDS('edited')} AS after FROM e),
    r AS (SELECT *, CASE WHEN before = 0 THEN 'empty_input' WHEN after / before <= 1 - 0.95 THEN 'dropped' WHEN after <= 10 THEN 'too_short' ELSE 'edited' END AS status FROM w)
    SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE chunks END AS BIGINT) AS chunks, CAST(removed AS BIGINT) AS removed_lines, CAST(0 AS BIGINT) AS errors, status, md5(CASE WHEN status = 'edited' THEN edited ELSE '' END) AS refined FROM r"""
)
def refine_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Documents from end to end: chunks of lines, a program for each, the programs put together, executed and accepted."""
    done = pipelines.refine_in_chunks(spread(documents(spark, d).select("doc_id", "text")), "text", budget=200)
    return done.select("doc_id", "chunks", "removed_lines", "errors", "status", F.md5("refined").alias("refined"))


_CUT = rf"""WITH RECURSIVE f AS (SELECT doc_id, {TEXT} AS text, 0 AS start, CAST(-1 AS BIGINT) AS chunk, '' AS piece FROM documents
      UNION ALL SELECT doc_id, text, start + length(piece), chunk + 1, piece FROM (SELECT doc_id, text, start, chunk, CASE WHEN start + 1000 >= length(text) THEN substr(text, start + 1) WHEN contains(substr(text, start + 501, 500), chr(10)) THEN substr(text, start + 1, 500 + length(regexp_extract(substr(text, start + 501, 500), '(?s)^.*\n'))) ELSE substr(text, start + 1, 1000) END AS piece FROM f WHERE start < length(text)))"""


@query(f"{_CUT} SELECT doc_id, CAST(count(*) FILTER (chunk >= 0) AS BIGINT) AS num_chunks, md5(coalesce(string_agg(replace(piece, '  ', ' '), chr(10) || chr(10) || '### OPENROUTER_CHUNK_PROGRAM ###' || chr(10) || chr(10) ORDER BY chunk) FILTER (chunk >= 0), '')) AS delimited FROM f GROUP BY doc_id")
def rewrite_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Documents written anew in chunks of characters, the outputs in one string with separators."""
    done = pipelines.rewrite_in_chunks(spread(documents(spark, d).select("doc_id", "text")), "text")
    return done.select("doc_id", "num_chunks", F.md5("programs_delimited").alias("delimited"))


@query(f"{_CUT} SELECT doc_id, md5(coalesce(string_agg(replace(piece, '  ', ' '), '' ORDER BY chunk) FILTER (chunk >= 0), '')) AS text, CAST(count(*) FILTER (length(piece) = 1000) AS BIGINT) AS stopped FROM f GROUP BY doc_id")
def rewrite_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same with the outputs joined in the text's place. Chunks of the full size stand for those that stopped at the model's limit."""
    done = pipelines.rewrite_in_chunks(spread(documents(spark, d).select("doc_id", "text")).withColumn("source", F.col("text")), "source")
    ends = chunking.character_cuts(F.col("source"), F.lit(1_000))
    reasons = F.transform("__ends", lambda e, i: F.when(e - F.when(i == 0, 0).otherwise(F.get("__ends", i - 1)) == 1_000, "length").otherwise("stop"))
    done = pipelines.merge_rewrites(done, "programs").withColumn("__ends", ends).withColumn("__reasons", reasons)
    return done.select("doc_id", F.md5("text").alias("text"), pipelines.stopped_chunks(F.col("programs"), F.col("__reasons")).alias("stopped"))


@query(
    f"""WITH b AS (SELECT source_parquet, source_row_index, list(body ORDER BY chunk_index) AS bodies FROM (SELECT source_parquet, source_row_index, chunk_index, coalesce(arg_min(coalesce(chunk_body, ''), chunk_id), '') AS body FROM denoise_dataset GROUP BY ALL) GROUP BY ALL)
    SELECT count(*) AS documents, CAST(count(*) FILTER (len(bodies) = len(programs) AND trim(array_to_string(programs, ''), ' ') <> '' AND bodies <> programs) AS BIGINT) AS changed, CAST(count(*) FILTER (trim(array_to_string(programs, ''), ' ') = '') AS BIGINT) AS dropped, CAST(count(*) FILTER (len(bodies) <> len(programs)) AS BIGINT) AS mismatched FROM b JOIN ({_OUTPUTS}) USING (source_parquet, source_row_index)"""
)
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many source rows changed, came out empty, or have another number of outputs than chunks."""
    key = ["source_parquet", "source_row_index"]
    once = table(spark, d, "denoise_dataset").groupBy(*key, "chunk_index").agg(F.min_by(T.filled(F.col("chunk_body")), "chunk_id").alias("body"))
    bodies = once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))), lambda x: x["body"]).alias("bodies"))
    return pipelines.pair_counts(bodies.join(distinct_outputs(spark, d), key), F.col("bodies"), F.col("programs"))


@query("SELECT source_parquet, source_row_index, count(*) AS rows, min(chunk_index) <> 0 OR max(chunk_index) <> count(*) - 1 OR count(DISTINCT chunk_index) <> count(*) AS has_gaps FROM denoise_dataset GROUP BY ALL")
def chunk_order(spark: SparkSession, d: str) -> DataFrame:
    """Source rows whose chunks are not there once each."""
    return pipelines.in_order(table(spark, d, "denoise_dataset"), ["source_parquet", "source_row_index"], "chunk_index")


_SEP = "chr(10) || chr(10) || '### OPENROUTER_CHUNK_PROGRAM ###' || chr(10) || chr(10)"


@query(
    f"""SELECT source_parquet, source_row_index, CAST(CASE WHEN programs_delimited = '' THEN 0 ELSE len(string_split(programs_delimited, {_SEP})) END AS BIGINT) AS parts,
    array_to_string(programs, {_SEP}) = programs_delimited AS round_trip, CAST(length(replace(programs_delimited, {_SEP}, '')) AS BIGINT) AS bare_chars, num_chunks <> len(programs) AS wrong_count FROM ({_OUTPUTS})"""
)
def delimiter_round_trip(spark: SparkSession, d: str) -> DataFrame:
    one = F.col("programs_delimited")
    return distinct_outputs(spark, d).select(
        "source_parquet", "source_row_index", F.size(T.split_outputs(one)).cast("bigint").alias("parts"), (T.join_outputs(F.col("programs")) == one).alias("round_trip"), F.length(T.without_separators(one)).cast("bigint").alias("bare_chars"), (F.col("num_chunks") != F.size("programs")).alias("wrong_count")
    )


@query(f"SELECT doc_id, md5(CASE WHEN length({TEXT}) > 120 THEN substr({TEXT}, 1, 120) || ' …' ELSE {TEXT} END) AS short, md5(CASE WHEN length({TEXT}) > 400 THEN left({TEXT}, 200) || '...' || right({TEXT}, 200) ELSE {TEXT} END) AS ends FROM documents")
def display_cuts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.md5(T.shortened(F.col("text"), 120)).alias("short"), F.md5(T.head_and_tail(F.col("text"), 400)).alias("ends"))


@query(
    r"""SELECT id, md5(translate(lower(query), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')) AS bare, regexp_replace(regexp_replace(replace(query, ' [title]', '. '), '\[[^\]]*\]', '', 'g'), '  ', ' ', 'g') = query AS no_brackets,
    CASE WHEN regexp_extract('#### ' || replace(regexp_extract(query, '[0-9]+'), '0', '0,0'), '#### (\-?[0-9\.\,]+)', 1) = '' THEN '[invalid]' ELSE replace(regexp_extract('#### ' || replace(regexp_extract(query, '[0-9]+'), '0', '0,0'), '#### (\-?[0-9\.\,]+)', 1), ',', '') END AS number FROM doc"""
)
def text_normalisers(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    number = F.concat(F.lit("#### "), F.replace(F.regexp_extract(q, "[0-9]+", 0), F.lit("0"), F.lit("0,0")))
    return table(spark, d, "doc").select("id", F.md5(T.without_punctuation(q)).alias("bare"), (T.without_brackets(q) == q).alias("no_brackets"), T.final_number(number).alias("number"))


@query(f"SELECT md5(string_agg(b, '' ORDER BY p)) AS corpus_hash, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT left(h, 4) AS p, md5(string_agg(h || ':' || c, '' ORDER BY h)) AS b, sum(c) AS n FROM (SELECT sha256({TEXT}) AS h, count(*) AS c FROM documents GROUP BY 1) GROUP BY 1)")
def corpus_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of all texts that does not depend on their order: first of each hash with its count (copies are summed before they are shuffled), then of
    those that begin alike, then of these."""
    hashes = documents(spark, d).groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c"))
    item = F.concat("h", F.lit(":"), F.col("c").cast("string"))
    starts = hashes.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(item)), "")).alias("b"), F.sum("c").alias("n"))
    # at most 65,536 rows
    return starts.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "b"))), lambda x: x["b"]), "")).alias("corpus_hash"), F.sum("n").alias("rows"))
