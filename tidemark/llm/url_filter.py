"""URL filter: rules, and a character language-model ratio for the rest.

Two variable-order Markov models over the bytes of a URL, one of accepted and
one of rejected URLs, interpolate orders 0 to ``ORDER`` by Witten-Bell-like
smoothing.  Their tables are hashed to ``SLOTS`` counters an order, so their size
is fixed whatever the input.  The difference of log-likelihoods by byte (in
bits) is calibrated on a held-out fifth of the labelled URLs: the threshold with
the best balanced accuracy separates accepted from rejected.

Labels come from the rules (what they allow or block) and from seed terms:
a URL no rule fits is rejected if its host holds a term, else weakly accepted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing

ORDER = 4
SLOTS = 1 << 17
STRENGTH = 2.0
BIN = 0.01
SPAN = 20.0
_A2Z = "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


# Rules and terms of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
TERMS = ("spam", "casino", "pills", "bets", "adult", "porn", "xxx", "ads-", "viagra", "gambl", "loan", "cheap")


def host_of(url) -> F.Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)", 1), _A2Z.upper(), _A2Z)


def path_of(url) -> F.Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host, path, rules: Sequence[Rule] = RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule for the host or a parent of it whose path starts the URL's; null if none."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _contexts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For every byte and URL end: the text's number; the lengths; and by order the slots of context and of context with byte."""
    raw, at = hashing.buffers(column)
    raw = hashing.lowered(raw)
    n = np.diff(at)
    ends = at[1:] + np.arange(len(n))
    whole = np.zeros(len(raw) + len(n), np.uint64)
    inside = np.ones(len(whole), bool)
    inside[ends] = False
    whole[inside] = raw.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(whole)) - np.repeat(ends - n, n + 1)
    slots, context = [], np.zeros(len(whole), np.uint64)
    for k in range(ORDER + 1):
        if k:
            back = np.zeros(len(whole), np.uint64)
            back[k:] = whole[:-k] if k < len(whole) else 0
            back[place < k] = 300
            context = context * np.uint64(521) + back
        bare = hashing.mix(context * np.uint64(ORDER + 1) + np.uint64(k))
        slots.append(((bare % np.uint64(SLOTS)).astype(np.int64), (hashing.mix(bare + whole + np.uint64(1)) % np.uint64(SLOTS)).astype(np.int64)))
    return owner, n + 1, slots


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = np.zeros((2, ORDER + 1, 2, SLOTS), np.int64)
    for whole in batches:
        for batch in hashing.slices(whole, "url"):
            rejected = np.asarray(batch.column("rejected").to_numpy(zero_copy_only=False), bool)
            owner, _, slots = _contexts(batch.column("url"))
            for c in (0, 1):
                mine = rejected[owner] == bool(c)
                for k, pair in enumerate(slots):
                    for j, slot in enumerate(pair):
                        tables[c, k, j] += np.bincount(slot[mine], minlength=SLOTS)
    flat = tables.ravel()
    used = np.flatnonzero(flat)
    for first in range(0, len(used), 100_000):
        some = used[first : first + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["slot", "n"])


class UrlModel:
    """Counter tables of both classes; fixed size, so it may be broadcast."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    def bits(self, column: pa.Array) -> np.ndarray:
        """Length-normalised log2 ratio, accepted over rejected, of each URL (null: empty)."""
        if len(column) == 0:
            return np.empty(0)
        owner, n, slots = _contexts(column)
        ratio = np.zeros(len(owner))
        for c, sign in ((0, 1.0), (1, -1.0)):
            p = np.full(len(owner), 1 / 257)
            for k, (bare, full) in enumerate(slots):
                p = (self.tables[c, k, 1][full] + STRENGTH * p) / (self.tables[c, k, 0][bare] + STRENGTH)
            ratio += sign * np.log2(p)
        return np.bincount(owner, ratio, minlength=len(n)) / n


def train(labelled: DataFrame) -> UrlModel:
    """From ``labelled(url, rejected)``: the counts of both classes."""
    counts = labelled.select("url", "rejected").mapInArrow(_count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    tables = np.zeros(2 * (ORDER + 1) * 2 * SLOTS, np.float32)
    found = counts.toArrow()  # at most as many rows as there are counters
    tables[found["slot"].to_numpy()] = found["n"].to_numpy()
    return UrlModel(tables.reshape(2, ORDER + 1, 2, SLOTS))


def scorer(spark, model: UrlModel):
    """A column function: the model's bits of a URL."""
    shared = spark.sparkContext.broadcast(model.tables)

    @F.arrow_udf("double")
    def bits(url: pa.Array) -> pa.Array:
        return pa.array(UrlModel(shared.value).bits(url))

    return bits


def calibrate(scored: DataFrame) -> float:
    """The threshold with the best balanced accuracy over ``scored(bits, rejected)``; 0 without both classes."""
    place = F.least(F.lit(SPAN), F.greatest(F.lit(-SPAN), F.col("bits")))
    bins = scored.groupBy(F.floor(place / BIN).alias("bin"), "rejected").count().collect()  # at most 2 * (2 * SPAN / BIN + 1) rows
    low, n = -round(SPAN / BIN), 2 * round(SPAN / BIN) + 1
    hist = np.zeros((2, n))
    for r in bins:
        hist[int(r["rejected"]), min(max(r["bin"] - low, 0), n - 1)] += r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    accepted_above = hist[0][::-1].cumsum()[::-1] / hist[0].sum()
    rejected_below = np.concatenate([[0.0], hist[1].cumsum()[:-1]]) / hist[1].sum()
    good = accepted_above + rejected_below
    best = np.flatnonzero(good == good.max())
    return float((low + best[len(best) // 2]) * BIN)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, terms: Sequence[str] = TERMS) -> DataFrame:
    """``pages`` plus host, path, rule, bits, threshold and verdict (allow or block).

    A null URL, or one without ``://``, has empty host and path and fits no rule;
    the model scores it as the text it is (null as empty).  Columns passed in
    under the added names are replaced.  The rules are a parameter: a few, not data.
    """
    spark = pages.sparkSession
    base = pages.drop("host", "path", "rule", "bits", "threshold", "verdict")
    judged = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    term = F.lit(False)
    for t in terms:
        term = term | F.contains("host", F.lit(t))
    rejected = F.coalesce(F.col("_rule.verdict") == "block", term)
    labelled = judged.filter("host <> ''").select("url", rejected.alias("rejected"), (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0).alias("held_out"))
    model = train(labelled.filter("not held_out"))
    bits = scorer(spark, model)
    threshold = calibrate(labelled.filter("held_out").select(bits("url").alias("bits"), "rejected"))
    scored = judged.withColumns({"bits": bits("url"), "threshold": F.lit(threshold)})
    return scored.withColumns(
        {"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", F.when(F.col("bits") >= threshold, "allow").otherwise("block"))}
    ).drop("_rule")
