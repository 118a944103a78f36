"""Line dedup with content-defined chunks of lines.

A text's lines are hashed; a rolling hash over two neighbouring line hashes
chooses chunk boundaries, so an insertion moves boundaries only near itself.
Lines of ``solid_line`` words or more have boundaries on both sides by their own
content, so that a passage of a few such lines does not grow together with what
stands around it.

A chunk occurring elsewhere (in the same text too) is removed everywhere but at
its first occurrence, by (doc_id, text hash, position), if it has several lines,
or follows or precedes another repeated chunk whose first occurrence is its
neighbour as well (both are one repeated chunk of several lines), or is one line
of ``long_line`` words, or lies in a run of repeated chunks with ``run_words``
words.  Blank chunks don't break a run.  Equality is decided by the chunks'
bytes; 64-bit hashes only find candidates.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Scratch

LONG_LINE = 25
SOLID_LINE = 6
RUN_WORDS = 50
MODULUS = 2

_KEY = ["doc_id", "text_hash"]


def _blanks(x) -> F.Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _chunked(docs: DataFrame, solid_line: int, modulus: int) -> DataFrame:
    """``docs(doc_id, text)`` with text_hash and ``chunks``: struct(first, last) line numbers, 1-based."""
    lines = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    marked = lines.withColumn("marks", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (_blanks(x) >= solid_line - 1).alias("solid"))))
    cut = marked.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(1), F.size("lines")),
            lambda i: (i == 1)
            | F.get("marks", i - 1)["solid"]
            | F.get("marks", i - 2)["solid"]
            | (F.pmod(F.xxhash64(F.get("marks", i - 2)["h"], F.get("marks", i - 1)["h"]), F.lit(modulus)) == 0),
        ),
    )
    ends = F.transform("starts", lambda s, k: F.struct(s.alias("first"), (F.coalesce(F.get("starts", k + 1), F.size("lines") + 1) - 1).alias("last")))
    return cut.select("doc_id", "text_hash", "lines", ends.alias("chunks"))


def _body(span) -> F.Column:
    return F.array_join(F.slice("lines", span["first"], span["last"] - span["first"] + 1), "\n", "")


def repeated_chunks(docs: DataFrame, scratch: Scratch, long_line: int = LONG_LINE, run_words: int = RUN_WORDS, modulus: int = MODULUS, solid_line: int = SOLID_LINE) -> DataFrame:
    """One row for each chunk to remove: doc_id, text_hash, first, last, kept_in (doc_id of the kept occurrence)."""
    docs = docs.select("doc_id", "text").filter("text is not null and text <> ''")
    chunked = _chunked(docs, solid_line, modulus)
    each = F.transform(
        "chunks",
        lambda c: F.struct(
            F.xxhash64(_body(c)).alias("h"),
            c["first"].alias("first"),
            c["last"].alias("last"),
            F.aggregate(F.slice("lines", c["first"], c["last"] - c["first"] + 1), F.lit(0), lambda n, x: n + _blanks(x) + F.when(F.length(x) > 0, 1).otherwise(0)).alias("words"),
        ),
    )
    # Chunks are numbered without the blank ones.
    rows = chunked.select(*_KEY, F.posexplode(F.filter(each, lambda c: c["words"] > 0)).alias("k", "c")).select(*_KEY, "k", "c.*")
    rows = scratch.table(rows, "chunks")
    often = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "k")).alias("keep")).filter("n > 1").select("h", "keep")
    # Stored first: Spark splits a very common chunk's rows only if both sides come plainly from a shuffle.
    held = rows.join(scratch.table(often, "often").hint("merge"), "h")
    at = Window.partitionBy(*_KEY).orderBy("k")
    run = held.withColumn("island", F.col("k") - F.dense_rank().over(at))
    run = run.withColumn("_copy", F.row_number().over(Window.partitionBy(*_KEY, "k").orderBy("first"))).filter("_copy = 1").drop("_copy")  # rows repeating both
    island = Window.partitionBy(*_KEY, "island")

    def next_to(other, step: int):
        same = (F.col("keep.text_hash") == other["text_hash"]) & F.col("keep.doc_id").eqNullSafe(other["doc_id"])
        return F.coalesce(same & (F.col("keep.k") + step == other["k"]), F.lit(False))

    several = next_to(F.lag("keep").over(island.orderBy("k")), -1) | next_to(F.lead("keep").over(island.orderBy("k")), 1)
    run = run.withColumns({"total": F.sum("words").over(island), "several": several})
    found = scratch.table(
        run.filter((F.col("last") > F.col("first")) | F.col("several") | (F.col("words") >= long_line) | (F.col("total") >= run_words)).select("h", "keep", *_KEY, "k", "first", "last"),
        "held",
    )
    # The bytes of every candidate, from the texts that have one; a hash whose bytes differ is left alone.
    spans = found.groupBy(*_KEY).agg(F.collect_list(F.struct("h", "first", "last")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    texts = docs.select("doc_id", "text").join(spans.hint("merge"), same).withColumn("lines", F.split("text", "\n"))
    bodies = texts.select(F.explode(F.transform("spans", lambda c: F.struct(c["h"].alias("h"), _body(c).alias("body")))).alias("c")).select("c.*")
    differ = scratch.table(bodies.groupBy("h").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).filter("lo <> hi").select("h"), "differ")
    if not differ.isEmpty():
        found = found.join(differ, "h", "left_anti")
    later = F.struct(*_KEY, "k") != F.col("keep")
    return found.filter(later).select(*_KEY, "first", "last", F.col("keep.doc_id").alias("kept_in"))


def dedup_lines(docs: DataFrame, long_line: int = LONG_LINE, run_words: int = RUN_WORDS, modulus: int = MODULUS, solid_line: int = SOLID_LINE) -> DataFrame:
    """``docs`` with the repeated chunks cut out of ``text``.

    Adds n_lines, n_removed (lines), removed (array of struct(first, last)) and
    kept_in (sorted doc_ids of the documents that keep what was cut).  A null
    text stays null with zero counts; an empty one stays empty; texts of any
    length are cut whole.  Rows repeating both doc_id and text share one decision
    and count as one occurrence.  Other columns pass through; of clashing names
    the added column wins.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    cuts = repeated_chunks(docs, scratch, long_line, run_words, modulus, solid_line)
    cuts = cuts.distinct().groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_cuts"), F.array_sort(F.collect_set("kept_in")).alias("_kept"))
    cuts = scratch.table(cuts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_cuts", "_kept"), "cuts")
    plain = docs.drop("n_lines", "n_removed", "removed", "kept_in")
    joined = plain.withColumn("_hash", F.xxhash64("text")).join(cuts.withColumnRenamed("_hash", "_h2").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h2")), "left")
    lines = F.split("text", "\n")
    edges = F.concat(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"))), F.col("_cuts"))
    pieces = F.transform(edges, lambda c, i: F.slice(F.col("_lines"), c["last"] + 1, F.greatest(F.coalesce(F.get("_cuts", i)["first"], F.size("_lines") + 1) - c["last"] - 1, F.lit(0))))
    cleaned = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n", ""))
    out = joined.withColumn("_lines", F.when(F.col("_cuts").isNotNull(), lines))
    return (
        out.withColumns(
            {
                "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"),
                "n_removed": F.coalesce(F.aggregate("_cuts", F.lit(0), lambda n, c: n + c["last"] - c["first"] + 1), F.lit(0)).cast("long"),
                "removed": F.coalesce("_cuts", F.expr("cast(array() as array<struct<first:int,last:int>>)")),
                "kept_in": F.coalesce("_kept", F.expr("cast(array() as array<bigint>)")),
                "text": cleaned,
            }
        )
        .drop("_id", "_hash", "_h2", "_cuts", "_kept", "_lines")
    )
