"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector to the signs of ``bits`` random projections and
sorts all vectors by the concatenated bits, so that close vectors tend to be
neighbours.  A sorted partition is read as a stream: each block of ``block``
vectors is compared with itself and the block before; the edges of neighbouring
partitions are compared in a step of their own.  Verified pairs are united over
all passes.  Equal vectors are one class from the start.

The number of passes follows the number of vectors: a pair at the threshold
shares each bit with a chance of 1 - angle / pi, and stays within a window while
about log2(n / block) leading bits are shared; as many passes run as bring its
chance to be found to ``RECALL``.

Within the components found, links are counted exactly, emitting one count a
vector, never pairs, so the links of a dense group do not depend on how many
neighbours a window holds.  In a large component a vector whose angle to the
centre plus the largest such angle is within the threshold's is linked to all
others and needs no comparison; only the rest is compared, in parts, with the
component.  That is linear for a group of near copies and quadratic only for a
wide component's rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.store import Scratch

THRESHOLD = 0.95
RECALL = 0.998
LEAST_PASSES = 8
BLOCK = 512
BITS = 60
PART = 1024
BUCKET = 4096
ROWS = 65_536
BROADCAST_CENTRES = 10_000
BROADCAST_CLASSES = 1_000_000


def passes_for(n: int, threshold: float = THRESHOLD, block: int = BLOCK, recall: float = RECALL) -> int:
    """Passes after which a lone pair at the threshold among ``n`` vectors is found with a chance of ``recall``."""
    same = 1 - math.acos(threshold) / math.pi
    found = same ** max(0.0, math.log2(max(n, 1) / block))
    return LEAST_PASSES if found >= 1 else max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _unit(rows) -> np.ndarray:
    x = np.asarray(list(rows), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: pd.Series) -> Iterator[np.ndarray]:
    lengths = vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _key_rows(passes: int, bits: int):
    """Each vector once for each pass, with its key in the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                vectors = batch.column("embedding").to_pandas()
                for at in _by_length(vectors):
                    x = _unit(vectors.to_numpy()[at])
                    n = x.shape[1]
                    if n not in planes:
                        planes[n] = np.random.default_rng([20_077, n]).standard_normal((n, passes * bits))
                    sign = (x @ planes[n] >= 0).reshape(len(x), passes, bits)
                    key = (sign.astype(np.int64) << np.arange(bits - 1, -1, -1, dtype=np.int64)).sum(axis=2)
                    some = batch.take(pa.array(at))
                    for k in range(passes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), n, np.int32)), pa.array(key[:, k]), some.column("cls"), some.column("embedding")], names=["pass", "dim", "key", "cls", "embedding"]
                        )

    return run


def _spanning(x: np.ndarray, ids: np.ndarray, old: int, threshold: float) -> list[np.ndarray]:
    """Spanning links (a, b) of the near pairs that have a vector after the first ``old`` ones."""
    near = x[old:] @ x.T >= threshold
    near[np.arange(len(x) - old), np.arange(old, len(x))] = True
    label = np.arange(len(x))
    while True:  # smallest place reachable
        low = label.copy()
        low[old:] = np.where(near, label[None, :], len(x)).min(axis=1)
        np.minimum(low, np.where(near, low[old:, None], len(x)).min(axis=0, initial=len(x)), out=low)
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(x))
    return [ids[label[moved]], ids[moved]]


_SCAN = "a long, b long, edge int, side int, pass int, dim int, cls long, embedding array<{}>"


def _scan_rows(threshold: float, block: int, element: pa.DataType):
    """Links within a sorted partition, and the vectors at its two ends by the edge they lie at."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((c, pa.int32()) for c in ("edge", "side", "pass", "dim")), ("cls", pa.int64()), ("embedding", pa.list_(element))])

    def links(found: list[np.ndarray]) -> pa.RecordBatch:
        n = len(found[0])
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), *(pa.nulls(n, f.type) for f in list(schema)[2:])], schema=schema)

    def ends(batch: pa.RecordBatch, edge: int, side: int) -> pa.RecordBatch:
        n = batch.num_rows
        columns = [pa.nulls(n, pa.int64())] * 2 + [pa.array(np.full(n, v, np.int32)) for v in (edge, side)] + [batch.column(c) for c in ("pass", "dim", "cls")]
        return pa.RecordBatch.from_arrays([*columns, batch.column("embedding").cast(pa.list_(element))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, x, ids, seen, last, part = None, None, None, 0, None, 0
        for whole in batches:
            for first in range(0, whole.num_rows, block):
                batch = whole.slice(first, block)
                part = batch.column("part")[0].as_py()
                if seen < block:
                    yield ends(batch.slice(0, block - seen), part, 1)
                seen += batch.num_rows
                last = batch if last is None or batch.num_rows >= block else pa.concat_batches([last, batch])
                last = last.slice(max(0, last.num_rows - block))
                pass_, dim = batch.column("pass").to_numpy(), batch.column("dim").to_numpy()
                cut = [0, *(np.flatnonzero((pass_[1:] != pass_[:-1]) | (dim[1:] != dim[:-1])) + 1), len(pass_)]
                for low, high in zip(cut, cut[1:], strict=False):
                    some = batch.slice(low, high - low)
                    here = pass_[low], dim[low]
                    new = _unit(some.column("embedding").to_pandas())
                    own = some.column("cls").to_numpy()
                    old = 0 if here != space else min(block, len(x))
                    if old:
                        new, own = np.vstack([x[-old:], new]), np.concatenate([ids[-old:], own])
                    space, x, ids = here, new, own
                    found = _spanning(x, ids, old, threshold)
                    if len(found[0]):
                        yield links(found)
        if last is not None:
            yield ends(last, part + 1, 0)

    return run


def _edge_links(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in rows.groupby(["pass", "dim"], sort=False):
            group = group.sort_values("side")
            old = int((group["side"] == 0).sum())
            if 0 < old < len(group):
                a, b = _spanning(_unit(group["embedding"]), group["cls"].to_numpy(), old, threshold)
                found.append(pd.DataFrame({"a": a, "b": b}))
        return pd.concat(found) if found else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})

    return run


def _counts(threshold: float, keys: list[str]):
    """By ``keys``: for each asked vector (``ask``) the copies of the others (``told``) near to it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"cls": np.empty(0, np.int64), "links": np.empty(0, np.int64)})]
        for _, group in rows.groupby(keys, sort=False):
            for at in _by_length(group["embedding"]):
                some = group.iloc[at]
                x, ids, many = _unit(some["embedding"]), some["cls"].to_numpy(), some["copies"].to_numpy()
                ask, told = some["ask"].to_numpy(bool), some["told"].to_numpy(bool)
                if ask.any() and told.any():
                    near = (x[ask] @ x[told].T >= threshold) & (ids[ask][:, None] != ids[told][None, :])
                    found.append(pd.DataFrame({"cls": ids[ask], "links": near @ many[told]}))
        return pd.concat(found)

    return run


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by component, as (component, pos, x)."""
    for batch in batches:
        frame = batch.to_pandas()
        for component, group in frame.groupby("component"):
            total = _unit(group["embedding"]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), component)), pa.array(np.arange(len(total))), pa.array(total)], names=["component", "pos", "x"])


def _angle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, c = _unit(batch.column("embedding").to_pandas()), np.asarray(batch.column("centre").to_pandas().tolist(), np.float64)
        c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-300)
        angle = np.arccos(np.clip((x * c).sum(axis=1), -1, 1))
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("component"), pa.array(angle)], names=["cls", "component", "angle"])


def _links_in_components(member: DataFrame, scratch: Scratch, threshold: float, part: int) -> DataFrame:
    """``(cls, links)`` from ``member(cls, embedding, copies, component)``: copies of the other vectors near to each."""
    spark = member.sparkSession
    size = member.groupBy("component").agg(F.count("*").alias("size"), F.sum("copies").alias("total"))
    size = scratch.table(size, "sizes")
    few = F.broadcast(size) if size.count() <= BROADCAST_CLASSES else size
    member = scratch.table(member.join(few, "component"), "member")
    small, large = member.filter(F.col("size") <= part), member.filter(F.col("size") > part)
    buckets = max(1, small.count() // BUCKET)
    whole = small.withColumns({"ask": F.lit(True), "told": F.lit(True)})
    counted = whole.groupBy(F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket")).applyInPandas(_counts(threshold, ["component"]), "cls long, links long")
    if large.isEmpty():
        return counted

    sums = large.select("component", "embedding").mapInArrow(_sum_rows, "component long, pos long, x double").groupBy("component", "pos").agg(F.sum("x").alias("x"))
    centres = scratch.table(sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre")), "centres")
    near = F.broadcast(centres) if centres.count() <= BROADCAST_CENTRES else centres
    angles = scratch.table(large.select("cls", "component", "embedding").join(near, "component").mapInArrow(_angle_rows, "cls long, component long, angle double"), "angles")
    top = angles.groupBy("component").agg(F.max("angle").alias("top"))
    top = F.broadcast(top) if centres.count() <= BROADCAST_CLASSES else top
    limit = math.acos(threshold) - 1e-6
    judged = scratch.table(large.join(angles.join(top, "component").select("cls", (F.col("angle") + F.col("top") <= limit).alias("inner")), "cls"), "judged")
    easy = judged.filter("inner").select("cls", (F.col("total") - F.col("copies")).alias("links"))
    rest = judged.filter(~F.col("inner"))
    blocks = rest.groupBy("component").agg(F.ceil(F.count("*") / part).cast("int").alias("rests"))
    blocks = scratch.table(blocks, "rests")
    if blocks.isEmpty():
        return counted.unionByName(easy)
    every = judged.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_CLASSES else blocks, "component").withColumn("parts", F.ceil(F.col("size") / part).cast("int"))
    told = every.withColumns({"p": F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"), "r": F.explode(F.sequence(F.lit(0), F.col("rests") - 1)), "ask": F.lit(False), "told": F.lit(True)})
    ask = every.filter(~F.col("inner")).withColumns({"r": F.pmod(F.xxhash64("cls", F.lit(1)), F.col("rests")).cast("int"), "p": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "ask": F.lit(True), "told": F.lit(False)})
    columns = ["component", "p", "r", "cls", "embedding", "copies", "ask", "told"]
    hard = told.select(*columns).unionByName(ask.select(*columns)).groupBy(F.xxhash64("component", "p", "r").alias("bucket")).applyInPandas(_counts(threshold, ["component", "p", "r"]), "cls long, links long")
    return counted.unionByName(easy).unionByName(hard.groupBy("cls").agg(F.sum("links").alias("links")))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int | None = None, block: int = BLOCK, bits: int = BITS, part: int = PART) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do rows without a vec_id; vectors of different lengths
    never link.  Equal vectors always link.  Repeated vec_ids are rows of their
    own, each with the links of its vector; component_id is the smallest vec_id
    of the component, so several rows of that id may be kept.  Other columns are
    ignored; an empty table gives an empty one.  Cosines are computed in double
    precision.  ``passes`` defaults to ``passes_for`` the distinct vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed-dedup")
    x = F.col("embedding")
    fine = F.coalesce(
        F.forall(x, lambda e: e.isNotNull()) & F.forall(x, lambda e: ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0),
        F.lit(False),
    ) & F.col("vec_id").isNotNull()
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(f"array<{kind}>").alias("embedding"))
    good = rows.filter(fine)
    # An id of its own for every distinct vector: vec_ids may repeat.
    classes = scratch.table(good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    passes = passes_for(n, threshold, block) if passes is None else passes

    keyed = classes.select("cls", "embedding").mapInArrow(_key_rows(passes, bits), f"pass int, dim int, key long, cls long, embedding array<{kind}>")
    order = ["pass", "dim", "key", "cls"]
    placed = keyed.repartitionByRange(max(1, -(-n * passes // ROWS)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    scan = scratch.table(placed.mapInArrow(_scan_rows(threshold, block, pa.float32() if kind == "float" else pa.float64()), _SCAN.format(kind)), "scan")
    ends = scan.filter("edge is not null").select("edge", "side", "pass", "dim", "cls", "embedding")
    across = ends.groupBy("edge").applyInPandas(_edge_links(threshold), "a long, b long")
    links = scan.filter("edge is null").select("a", "b").unionByName(across).distinct()
    label = scratch.table(connected_components(links, scratch).select(F.col("node").alias("cls"), "component"), "label")

    member = classes.join(label, "cls").select("cls", "embedding", "copies", "component")
    counted = _links_in_components(member, scratch, threshold, part)
    first = classes.select("cls", "first").join(label, "cls").groupBy("component").agg(F.min("first").alias("component_id"))
    named = label.join(first, "component").join(counted, "cls", "left").select("cls", "component_id", "links")
    known = classes.join(named, "cls", "left").select(
        "embedding", "first", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id")
    )
    known = scratch.table(known, "known")
    once = known.filter("copies = 1").select(F.col("first").alias("vec_id"), "n_links", "component_id")
    often = known.filter("copies > 1").select(F.col("embedding").alias("_e"), F.xxhash64("embedding").alias("_h"), "n_links", "component_id")
    same = (F.xxhash64("embedding") == F.col("_h")) & (F.col("embedding") == F.col("_e"))
    several = good.join(F.broadcast(often) if often.count() * passes <= BROADCAST_CENTRES else often, same).select("vec_id", "n_links", "component_id")
    none = rows.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return once.unionByName(several).unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
