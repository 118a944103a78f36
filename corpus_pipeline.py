"""The corpus pipeline: stages over ``documents``, each one operator of ``tidemark.llm``.

A stage gets all rows its predecessor kept and returns the columns of documents;
the last adds how often the mix takes each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import without_leaks
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources, take_mix
from tidemark.llm.ngram_join import without_near_copies
from tidemark.llm.quality import classify
from tidemark.llm.store import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with their columns as they are.

    Null and blank texts are rejected; repeated rows are judged alike, by their
    text; a null doc_id has no label; an empty table stays empty.  Columns other
    than those of documents are dropped, here and in every stage.
    """
    scored = classify(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("accepted").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that an earlier document (by doc_id) or an earlier place has.

    n_chars becomes the length of what is left; a document of which nothing is
    left goes.  A text without repeated chunks stays as it is, null and blank
    ones too; rows that repeat doc_id and text stay alike.
    """
    cleaned = dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.filter("n_removed = 0 or trim(text) <> ''").select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, null ids last.

    Rows are judged by doc_id and text together, and of repeated rows one stays;
    null and blank texts link with nothing and all stay.
    """
    return without_near_copies(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text leaks no benchmark item; rows without a text or with a null doc_id are judged like others."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies and taken words.

    Texts without words are taken 0 times and so go; a null source is a source of
    its own; rows that repeat doc_id and text share one count.
    """
    docs = docs.select(*COLUMNS)
    return take_mix(docs, mix_sources(docs)).select(*COLUMNS, "copies", "taken")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: Scores, candidate groups and Newton steps aren't SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; every stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
