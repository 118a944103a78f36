"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``cap`` copies.  Among all rates whose
expected words meet each source's target, those are taken that differ least from
``cap / 2`` copies each in (two-sided) entropy.  The convex dual has one variable
a source and gives exponentially tilted rates ``cap * s(l * size)`` with ``s``
the logistic function; Newton steps solve it from distributed sums, guarded by
bisection.  Rates become whole copies by systematic rounding in the order of
(size, hash of doc_id), which keeps each source's error within a document or so.
Sums run over counts of (source, size), and ranks within salted groups, so that
neither a hot source nor a hot size meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
GROUP = 4096
OFFSETS = 256
NEWTON_STEPS = 60


def size_of(text) -> F.Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _whole(x, offset) -> F.Column:
    return F.floor(x + offset + 1e-9)


def targets(sizes: list[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target words by source: ``share`` of all sizes by repeating weights, at most ``cap`` times a source's size.

    Sources are ordered by code point, null last.  What a source can't take is
    shared by weight among the others until none is above its limit.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(ordered)}
    limit = {s: float(cap * n) for s, n in ordered}
    total = share * sum(n for _, n in ordered)
    fixed: dict[str | None, float] = {}
    while True:
        rest = [s for s, _ in ordered if s not in fixed]
        left = total - sum(fixed.values())
        whole = sum(weight[s] for s in rest)
        goal = {s: left * weight[s] / whole for s in rest}
        above = [s for s in rest if goal[s] > limit[s]]
        if not above:
            return fixed | goal
        fixed |= {s: limit[s] for s in above}


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` plus size, source_size, target, rate, copies and taken (= copies * size).

    Null or blank texts have size 0 and are taken 0 times; a null source is a
    source of its own.  Repeated doc_ids are separate rows (ties by text hash).
    The state of the dual is one number a source, held by the driver: sources
    are the keys of the mixing table, not a number that grows with the rows.
    Columns passed in under the added names are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*added)
    plain = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_h"))
    plain = scratch.table(plain, "sizes")
    counts = scratch.table(plain.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    by_source = {r["source"]: r["words"] for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    goal = targets(list(by_source.items()), weights, share, cap) if sum(by_source.values()) else {s: 0.0 for s in by_source}

    # f(l) = sum n * cap * s(l * z) * size with z = size / mean size; f(0) is half the limit.
    rows = [r for r in counts.filter("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean")).collect()]
    state = {r["source"]: {"mean": float(r["mean"]), "l": 0.0, "lo": -60.0, "hi": 60.0, "open": 0 < goal[r["source"]] < cap * by_source[r["source"]]} for r in rows}
    for s, x in state.items():
        if not x["open"]:
            x["l"] = 60.0 if goal[s] > 0 else -60.0
    schema = "src string, null_src boolean, mean double, l double"

    def dual() -> DataFrame:
        return spark.createDataFrame([(s or "", s is None, x["mean"], x["l"]) for s, x in state.items()] or [("", True, 1.0, 0.0)], schema)

    def with_rate(df: DataFrame) -> DataFrame:
        same = (F.coalesce("source", F.lit("")) == F.col("src")) & (F.col("source").isNull() == F.col("null_src"))
        z = F.col("size") / F.col("mean")
        rate = F.when(F.col("l") >= 60, F.lit(float(cap))).when(F.col("l") <= -60, F.lit(0.0)).otherwise(cap / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("l") * z)))))
        return df.join(dual(), same, "left").withColumn("z", z).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0)).drop("src", "null_src", "mean", "l")

    for _ in range(NEWTON_STEPS):
        if not any(x["open"] for x in state.values()):
            break
        sums = with_rate(counts.filter("size > 0")).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.col("rate")).alias("f"),
            F.sum(F.col("n") * F.col("size") * F.col("z") * F.col("rate") * (1 - F.col("rate") / cap)).alias("g"),
        )
        for r in sums.collect():
            x, gap = state[r["source"]], r["f"] - goal[r["source"]]
            if not x["open"]:
                continue
            if abs(gap) <= 1e-9 * max(1.0, goal[r["source"]]):
                x["open"] = False
                continue
            x["lo"], x["hi"] = (x["l"], x["hi"]) if gap < 0 else (x["lo"], x["l"])
            step = x["l"] - gap / r["g"] if r["g"] > 1e-300 else x["lo"]
            x["l"] = step if x["lo"] < step < x["hi"] else (x["lo"] + x["hi"]) / 2

    # Systematic rounding: the running sum of rates in (size, hash) order, cut at whole numbers.
    rated = with_rate(counts).select("source", "size", "n", "rate")
    before = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    rated = scratch.table(rated.withColumn("before", F.coalesce(before, F.lit(0.0))).withColumn("salts", F.ceil(F.col("n") / GROUP)), "rates")
    # Where the running sum starts is free: of OFFSETS starts the one whose words come nearest to the target.
    start = rated.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))).withColumn("offset", (F.col("k") + 0.5) / OFFSETS)
    words = F.col("size") * (_whole(F.col("before") + F.col("n") * F.col("rate"), F.col("offset")) - _whole(F.col("before"), F.col("offset")))
    found = start.groupBy("source", "k", "offset").agg(F.sum(words).alias("words")).collect()  # OFFSETS rows a source
    best = {s: (float("inf"), 0, 0.5) for s in by_source}
    for r in found:
        best[r["source"]] = min(best[r["source"]], (abs(r["words"] - goal[r["source"]]), r["k"], float(r["offset"])))
    same = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.size") == F.col("b.size")]
    salt = F.floor((F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))) * F.col("salts")).cast("long")
    placed = plain.alias("a").join(rated.alias("b"), same[0] & same[1]).select("a.*", "rate", "before", "salts").withColumn("salt", salt)
    placed = scratch.table(placed, "placed")
    salted = placed.groupBy("source", "size", "salt").agg(F.count("*").alias("m"))
    ahead = salted.withColumn("ahead", F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    ranked = placed.alias("a").join(ahead.alias("b"), same[0] & same[1] & (F.col("a.salt") == F.col("b.salt"))).select("a.*", "ahead")
    ranked = ranked.withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("_h", "doc_id")) - 1)
    until = F.col("before") + F.col("rank") * F.col("rate")
    copies = _whole(until + F.col("rate"), F.col("offset")) - _whole(until, F.col("offset"))
    schema = "src string, null_src boolean, source_size long, target double, offset double"
    goals = spark.createDataFrame([(s or "", s is None, int(by_source[s]), float(goal[s]), best[s][2]) for s in by_source] or [("", True, 0, 0.0, 0.5)], schema)
    same_source = (F.coalesce("source", F.lit("")) == F.col("src")) & (F.col("source").isNull() == F.col("null_src"))
    done = ranked.join(goals, same_source).withColumn("copies", F.when(F.col("size") > 0, F.least(copies, F.lit(cap))).otherwise(0).cast("long"))
    done = done.select("doc_id", "source", "_h", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return scratch.table(done, "mix")


def take_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with copies and taken; rows repeating doc_id and text share one count."""
    taken = mix.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_hash")).agg(F.max("copies").alias("copies"), F.max("taken").alias("taken")).filter("copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc_id", "text") == F.col("_hash"))
    return docs.drop("copies", "taken").join(taken, same).drop("_id", "_hash")
