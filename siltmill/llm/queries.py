"""The problems' queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread, table
from .abuse import abuse_rate, score_abuse
from .byte_bpe import encode_texts, token_counts
from .containers import fill_report, pack_texts
from .leakage import leaked_items
from .page_body import main_text, site_lines
from .splitting import must_split, split_texts
from .subword_trie import token_budget
from .text_quality import not_prose, text_statistics
from .truncation import cut_rate, score_ends

#: Where the vocabulary files of the public tokenizers lie, on the driver and on every executor, unless spark.siltmill.tokenizers says otherwise.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    return f"{spark.conf.get('spark.siltmill.tokenizers', TOKENIZERS)}/{name}"


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "denoise_dataset").select("chunk_id", "chunk_body", *columns))


def texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(chunks(spark, d), "chunk_id", "chunk_body")


def p1_text_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(chunks(spark, d), "chunk_id", "chunk_body")


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget(chunks(spark, d, "source_parquet", "source_row_index", "dataset_type"), table(spark, d, "crawl_rows"), vocabulary(spark))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_ends(chunks(spark, d, "max_new_tokens", "source_parquet"), "chunk_id", "chunk_body", "max_new_tokens", ("source_parquet",))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_scores(spark, d).where("is_cut").select("chunk_id")


def p3_cut_rate(spark: SparkSession, d: str) -> DataFrame:
    return cut_rate(p3_scores(spark, d), "source_parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(chunks(spark, d), table(spark, d, "doc"), "chunk_id", "chunk_body")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines(chunks(spark, d), "chunk_id", "chunk_body")


def p5_main_text(spark: SparkSession, d: str) -> DataFrame:
    return main_text(chunks(spark, d), "chunk_id", "chunk_body")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return must_split(chunks(spark, d, "chunk_size", "chunk_overlap"), "chunk_id", "chunk_body", "chunk_size", "chunk_overlap")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(chunks(spark, d, "chunk_size", "chunk_overlap"), "chunk_id", "chunk_body", "chunk_size", "chunk_overlap")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(texts(spark, d), "doc_id", "text", vocabulary(spark))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(token_counts(texts(spark, d), "doc_id", "text", vocabulary(spark)), table(spark, d, "pack_config"))


def p8_fill_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_containers(spark, d))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_abuse(table(spark, d, "documents"), table(spark, d, "labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("is_abusive").select("doc_id")


def p9_abuse_rate(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rate(p9_scores(spark, d))


ALL = (
    p1_found, p1_text_statistics, p2_token_budget, p3_found, p3_scores, p3_cut_rate, p4_found, p5_found, p5_main_text, p6_found, p6_pieces, p7_ids, p8_containers, p8_fill_report, p9_found, p9_scores, p9_abuse_rate
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}

#: The other queries cannot be written in SQL; each operator is tested against a plain version of itself.
ORACLE_SQL: dict[str, str] = {"p6_found": "SELECT chunk_id FROM denoise_dataset WHERE chunk_size > 0 AND length(chunk_body) > chunk_size"}
