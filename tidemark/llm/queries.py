"""The registered ``opN_<name>`` queries: operators with production parameters over whole tables.

Each query is thin: it calls one operator and derives the columns that are
compared from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bloom_lm import score_texts
from tidemark.llm.decontaminate import leaks
from tidemark.llm.embed_dedup import near_duplicates
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.pii import KINDS, personal_data
from tidemark.llm.quality import classify
from tidemark.llm.url_filter import filter_urls
from tidemark.llm.warc import archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_good", "p_safe", "score", "accepted")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "bits", "threshold")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_table(spark, sf_dir, "documents"))

    def joined(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base", "found"))
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("found").cast("long").alias("n_found"), F.size(every).cast("long").alias("n_spans")
    )


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive(_table(spark, sf_dir, "pages"))
    read = F.col("payload").isNotNull()
    return back.select(
        "page_id",
        F.when(read, F.octet_length("payload")).otherwise(F.col("length")).cast("long").alias("payload_bytes"),
        F.when(read, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed", "kept_in", "text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """None of these results is a plain SQL query; the tests hold them against brute force."""
    return {}
