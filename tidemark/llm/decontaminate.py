"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked
again with other values keeps its template.  Windows of ``width`` canonical
words of the benchmark are hash-joined with those of the documents.  A window of
placeholders alone would fit any table of numbers; it is hashed by its literal
words instead.  A document leaks an item if, at one alignment, it holds at least
``cover`` of the item's windows and the placeholders are consistent: values of
the item's slots inside these windows and values of the document's correspond
one to one.  An alignment is one offset, or several with steps of at most
``width`` words, so that words put in or left out don't divide a passage.  All
of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.store import Scratch

WIDTH = 8
COVER = 0.5
BROADCAST_WINDOWS = 1_000_000
BROADCAST_DOCS = 2_000_000

# Words for units, after a number.
UNITS = (
    "percent", "mm", "cm", "m", "km", "meters", "metres", "miles", "feet", "inches", "mg", "g", "kg", "grams", "tons", "ml", "l", "liters", "litres",
    "s", "ms", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "mph", "kph", "dollars", "euros", "cents", "pounds", "degrees",
)
SLOTS = ("\u0001", "\u0002", "\u0003")
_SPACES = "\t\n\x0b\x0c\r"
_PUNCTUATION = r"""!"$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def canonical_words(text) -> tuple[F.Column, F.Column]:
    """Canonical words and, word by word, the plain ones of a text (null: none).

    A name is a capitalised word that doesn't start a sentence or line.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), "#\u0001\u0002\u0003", "    ")
    # The capital first, then what stands before it: the engine looks back at capitals only.
    named = F.regexp_replace(plain, r"\p{Lu}(?<=[\p{Ll}\p{N},;][ \t]\p{Lu})[\p{Ll}'-]+", "\u0001")
    numbered = F.regexp_replace(named, r"[+-]?[0-9][0-9.,:/]*[0-9]|[0-9]", "\u0002")
    united = F.regexp_replace(numbered, "(?<=\u0002 )(?:" + "|".join(UNITS) + r")\b", "\u0003")
    slotted = F.when(plain.rlike("[0-9]"), united).otherwise(named)

    def split(x) -> F.Column:
        bare = F.translate(F.lower(x), _SPACES + _PUNCTUATION, " " * len(_SPACES))
        return F.array_remove(F.split(bare, " "), "")

    return split(slotted), split(plain)


def _windows(rows: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """(key, n, pos, h) of every window of ``n`` words of ``rows(key, words, plain)`` for each of ``lengths``.

    Positions are exploded and then hashed, which compiles to one loop; a lambda over
    the positions would be interpreted.
    """

    def starts(n: int) -> F.Column:
        some = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"))) if len(lengths) > 1 else F.sequence(F.lit(1), F.size("words") - n + 1)
        return F.when(F.size("words") >= n, some)

    def hash_of(n: int) -> F.Column:
        places = [F.col("pos") + k for k in range(-1, n - 1)]
        words = [F.get("words", at) for at in places]
        slots = F.lit(True)
        for w in (words[0], words[-1], *words[1:-1]):
            slots = slots & w.isin(*SLOTS)
        return F.when(slots, F.xxhash64(F.lit(-n), *[F.get("plain", at) for at in places])).otherwise(F.xxhash64(F.lit(n), *words))

    wide = rows.filter(F.size("words") >= min(lengths)).select(key, "words", "plain")
    if len(lengths) == 1:
        placed = wide.select("*", F.explode(starts(lengths[0])).alias("pos")).withColumn("n", F.lit(lengths[0]))
    else:
        empty = F.expr("cast(array() as array<struct<n:int,pos:int>>)")
        placed = wide.select("*", F.explode(F.concat(*[F.coalesce(starts(n), empty) for n in lengths])).alias("w")).select(key, "words", "plain", "w.*")
    h = hash_of(lengths[0])
    for n in lengths[1:]:
        h = F.when(F.col("n") == n, hash_of(n)).otherwise(h)
    return placed.select(key, "n", "pos", h.alias("h"))


def _alignments(hits: DataFrame, width: int) -> DataFrame:
    """``hits`` by alignment: (doc, item_id, several, at, offset, item_pos, here).

    Every offset is an alignment, and so is every chain of neighbouring offsets,
    with each of the item's windows at the offset that has the most of them and
    each of the document's taken once.
    """
    pair = ["doc", "item_id"]
    here = F.count("*").over(Window.partitionBy(*pair, "offset"))
    step = F.col("offset") - F.lag("offset").over(Window.partitionBy(*pair).orderBy("offset"))
    chain = F.sum(F.when(step <= width, 0).otherwise(1)).over(Window.partitionBy(*pair).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("here", here).withColumn("chain", chain)
    place = F.row_number().over(Window.partitionBy(*pair, "chain", "item_pos").orderBy(F.desc("here"), "offset"))
    ends = Window.partitionBy(*pair, "chain")
    taken = F.row_number().over(Window.partitionBy(*pair, "chain", F.col("item_pos") + F.col("offset")).orderBy(F.desc("here"), "offset"))
    several = rows.withColumns({"lo": F.min("offset").over(ends), "hi": F.max("offset").over(ends)}).filter("lo < hi").withColumn("place", place).filter("place = 1").withColumn("taken", taken).filter("taken = 1")
    one = rows.select(*pair, F.lit(False).alias("several"), F.col("offset").cast("long").alias("at"), "offset", "item_pos", "here")
    return one.unionAll(several.select(*pair, F.lit(True), F.col("chain"), "offset", "item_pos", "here"))


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, cover: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """``(doc, item_id, windows, item_windows, covered, offset)``, and a bound of its rows; doc is struct(doc_id, hash of the text)."""
    item_words, item_plain = canonical_words(F.col("text"))
    items = benchmark.select("item_id", item_words.alias("words"), item_plain.alias("plain"))
    items = scratch.table(items, "items")
    # An item of fewer than ``width`` words has one window, of its own length.
    short = sorted(r.n for r in items.select(F.size("words").alias("n")).filter((F.col("n") > 0) & (F.col("n") < width)).distinct().collect())
    whole = _windows(items, "item_id", [width])
    for n in short:
        whole = whole.unionAll(_windows(items.filter(F.size("words") == n), "item_id", [n]))
    item_windows = scratch.table(whole.withColumnRenamed("pos", "item_pos"), "item-windows")
    n_windows = item_windows.count()
    doc_words, doc_plain = canonical_words(F.col("text"))
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc"), "text")
    doc_windows = _windows(keyed.select("doc", doc_words.alias("words"), doc_plain.alias("plain")), "doc", [*short, width])
    wanted = item_windows.drop("n")  # the hash knows the length
    hits = doc_windows.select("doc", "pos", "h").join(F.broadcast(wanted) if n_windows <= BROADCAST_WINDOWS else wanted, "h").select("doc", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct()
    sizes = item_windows.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    small = n_windows <= BROADCAST_WINDOWS
    # An alignment of several offsets can only add windows: pairs below the threshold in all their hits are out.
    enough = F.col("windows") >= cover * F.col("item_windows")
    hits = scratch.table(hits, "hits")
    n_hits = hits.count()
    pairs = hits.groupBy("doc", "item_id").agg(F.countDistinct("item_pos").alias("windows")).join(F.broadcast(sizes) if small else sizes, "item_id")
    hits = hits.join(pairs.filter(enough).select("doc", "item_id"), ["doc", "item_id"], "left_semi")
    alignment = ["doc", "item_id", "several", "at"]
    placed = _alignments(hits, width).withColumn("windows", F.count("*").over(Window.partitionBy(*alignment)))
    placed = scratch.table(placed.join(F.broadcast(sizes) if small else sizes, "item_id").filter(enough), "placed", 2 * n_hits)
    aligned = placed.groupBy(*alignment).agg(F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.max(F.struct("here", -F.col("offset"))).alias("best"))

    # Slots: positions inside matched windows where the item has a placeholder, with both plain values.
    slots = items.select("item_id", F.posexplode(F.arrays_zip("words", "plain")).alias("slot", "w")).filter(F.col("w.words").isin(*SLOTS))
    slots = slots.select("item_id", "slot", F.col("w.plain").alias("item_value"))
    inner = slots.join(item_windows.select("item_id", "item_pos", "n"), "item_id").filter((F.col("slot") >= F.col("item_pos") - 1) & (F.col("slot") < F.col("item_pos") - 1 + F.col("n")))
    inner = scratch.table(inner.select("item_id", "item_pos", "slot", "item_value"), "slots")
    if not inner.isEmpty():
        asked = placed.join(inner, ["item_id", "item_pos"]).select(*alignment, "item_value", (F.col("slot") + F.col("offset")).alias("doc_at")).distinct()
        asked = scratch.table(asked, "asked", 2 * width * n_hits)
        ids = asked.select("doc").distinct()
        plain = keyed.join(F.broadcast(ids) if ids.count() <= BROADCAST_DOCS else ids, "doc").dropDuplicates(["doc"]).select("doc", doc_words.alias("doc_words"), doc_plain.alias("doc_plain"))
        values = plain.join(asked, "doc").select(*alignment, "item_value", F.get("doc_words", F.col("doc_at")).alias("doc_type"), F.get("doc_plain", F.col("doc_at")).alias("doc_value"))
        values = scratch.table(values.filter(F.col("doc_type").isin(*SLOTS)).drop("doc_type").distinct(), "values", 2 * width * n_hits)
        # One to one: no value of one side stands for two of the other.
        for one, other in (("item_value", "doc_value"), ("doc_value", "item_value")):
            differing = values.groupBy(*alignment, one).agg(F.min(other).alias("lo"), F.max(other).alias("hi")).filter("lo <> hi")
            aligned = aligned.join(differing.select(*alignment).distinct(), alignment, "left_anti")
    best = aligned.groupBy("doc", "item_id").agg(F.max("best").alias("best"), F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"))
    best = best.select("doc", "item_id", F.col("best.here").alias("windows"), "item_windows", (F.col("windows") / F.col("item_windows")).alias("covered"), (-F.col("best.col2")).alias("offset"))
    return best, n_hits


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """``(doc_id, item_id, windows, item_windows, covered, offset)``: one row for each document and leaked item.

    ``docs(doc_id, text)`` and ``benchmark(item_id, text)``; null or blank texts,
    and empty tables, leak nothing; texts of any length are read whole.  A document
    is a doc_id (null is one like others) with a text: repeated rows count once,
    and of several texts with one doc_id the one that covers most is reported.
    Repeated item_ids are one item.  ``covered`` is the share of the item's
    windows in the best alignment; ``windows`` are those at its fullest
    ``offset``, the smallest of equals.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found, n_hits = _leaks(docs, benchmark, width, cover, scratch)
    measures = ["covered", "windows", "item_windows", (-F.col("offset")).alias("offset")]
    best = found.groupBy(F.col("doc.doc_id").alias("doc_id"), "item_id").agg(F.max(F.struct(*measures)).alias("m"))
    best = best.select("doc_id", "item_id", "m.windows", "m.item_windows", "m.covered", (-F.col("m.offset")).alias("offset"))
    return scratch.few(best, n_hits)


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """The rows of ``docs`` whose own text leaks no item; all columns stay as they are.

    Rows are judged by doc_id and text together, so a row that shares its doc_id
    with a leaking text stays, and so do rows without a text.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    found, n_hits = _leaks(docs, benchmark, width, cover, scratch)
    found = scratch.table(found.select("doc").distinct(), "leaking", n_hits)
    found = found.select(F.col("doc.doc_id").alias("_id"), F.col("doc.h").alias("_h"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_DOCS else found, same, "left_anti")
