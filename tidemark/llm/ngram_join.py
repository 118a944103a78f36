"""N-gram Jaccard join with prefix trees.

Every text becomes its set of word n-grams.  Two sets can reach Jaccard ``t``
only if they share elements among their first ones in any global order, so the
work has three steps:

1. *Hash-order prefixes.*  With ``k = max(1, n // 10)`` the ``n - ceil(t*n) + k``
   smallest hashes of two linking sets share at least the smaller ``k``.  Only
   prefix elements held by two different sets survive one shuffle.
2. *Rare-first prefixes.*  Of the sets left, whole, ``ceil(t*n)`` elements have to
   be held by others too; ordered by document frequency, all but the last
   ``ceil(t*n) - 1`` of these have to meet a partner's.  Sets that meet form
   candidate groups.
3. *Tries.*  The sets of a candidate group are stored in a trie whose paths are
   the sets in one global order, common elements first.  A probe walks it once,
   sharing the overlap of every path's start, and skips subtrees by the bound
   that the remaining lengths leave and subtrees already linked to the probe.

No set is capped and no pair is listed: a group yields spanning links only.
Candidate groups above ``chunk`` sets or ``elements`` elements are cut into chunks; components of chunks
are joined through leaders first, and then every set outside the group's largest
component is compared with all chunks, which covers every remaining pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import hashing
from tidemark.llm.graph import connected_components
from tidemark.llm.store import Scratch

PERCENT = 80
WIDTH = 5
CHUNK = 500
ELEMENTS = 2_000_000
GROUP_SETS = 125
GROUP_ELEMENTS = 1_000_000
BROADCAST_ROWS = 2_000_000
_BITS = np.uint64((1 << 55) - 1)
_ID_BITS = (1 << 47) - 1


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _set_rows(percent: int, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                word, first = hashing.word_hashes(batch.column("text"))
                out: list[tuple] = []
                for row in range(batch.num_rows):
                    grams = hashing.shingles(word[first[row] : first[row + 1]], width)
                    n = len(grams)
                    if n == 0:
                        out.append((0, None, None, None))
                        continue
                    digest = blake2b(grams.tobytes(), digest_size=16).digest()
                    d1, d2 = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
                    prefix = None
                    if d1 not in seen:
                        if len(seen) < 200_000:
                            seen.add(d1)
                        size = min(n, n - _least_overlap(n, percent) + max(1, n // 10))
                        prefix = (grams[:size] >> np.uint64(9)).astype(np.int64)
                    out.append((n, d1, d2, prefix))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *(pa.array(c, t) for c, t in zip(columns, schema.types[2:], strict=True))], schema=schema)

    return run


def _full_rows(width: int):
    schema = pa.schema([("cls", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                word, first = hashing.word_hashes(batch.column("text"))
                grams = [hashing.shingles(word[first[i] : first[i + 1]], width).view(np.int64) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(grams, schema.types[1])], schema=schema)

    return run


def _held(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, d, df) of the elements ``rows(h, d)`` that more than one set holds.

    Elements are aggregated before they meet, and joined back to their sets: a very
    common one is a single row on its side, and Spark splits its sets.
    """
    shared = rows.groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("df")).filter("low < high").select("h", "df")
    shared = scratch.table(shared, "shared")
    return rows.join(shared.hint("merge"), "h")  # one plan at every size


def _leaders(state: DataFrame, chunk: int, elements: int) -> DataFrame:
    """One set of the largest component of every chunk, all of a group together."""
    count = state.groupBy("cc", "part", "component").agg(F.count("*").alias("c"), F.min("cls").alias("cls"))
    return count.groupBy("cc", "part").agg(F.max_by("cls", F.struct("c", "cls")).alias("cls")).select("cc", F.lit("leaders").alias("part"), "cls")


def _rest(state: DataFrame, chunk: int, elements: int) -> DataFrame:
    """Every set outside its group's largest component, in blocks, with every chunk of the group."""
    count = state.groupBy("cc", "component").agg(F.count("*").alias("c"))
    main = count.groupBy("cc").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("k")).filter("k > 1").select("cc", F.col("top.component").alias("main"))
    still = state.join(main, "cc")
    rest = still.filter("component <> main").select("cc", "cls", "n")
    n_blocks = rest.groupBy("cc").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / elements)).cast("int").alias("n_blocks"))
    blocks = still.select("cc", "part").distinct().join(n_blocks, "cc")
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tag = F.concat_ws(":", "part", "block").alias("part")
    every = still.select("cc", "part", "cls").join(blocks, ["cc", "part"]).select("cc", tag, "cls")
    other = rest.join(blocks, "cc").filter(F.pmod(F.xxhash64("cls"), "n_blocks") == F.col("block")).select("cc", tag, "cls")
    return every.unionAll(other)


@dataclass(slots=True)
class _Node:
    path: np.ndarray
    low: int
    high: int
    tag: int | None
    leaves: list[int] = field(default_factory=list)
    below: dict[int, _Node] = field(default_factory=dict)


def trie_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning links ``(i, j)`` among distinct element sets whose Jaccard is at least ``percent`` %."""
    size = [len(s) for s in sets]
    if len(sets) < 2:
        return []
    pool, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(pool), np.int64)
    rank[np.lexsort((np.arange(len(pool)), -counts))] = np.arange(len(pool))
    ordered = [np.sort(x) for x in np.split(rank[inverse], np.cumsum(size)[:-1])]
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links: list[tuple[int, int]] = []
    marked = np.zeros(len(pool), bool)
    root = _Node(np.empty(0, np.int64), 0, 0, None)

    def insert(me: int) -> None:
        rest, node, n = ordered[me], root, size[me]
        while True:
            if node is root:
                node.low, node.high = min(node.low or n, n), max(node.high, n)
            if not len(rest):
                node.leaves.append(me)
                return
            child = node.below.get(int(rest[0]))
            if child is None:
                node.below[int(rest[0])] = _Node(rest, n, n, me, [me])
                return
            short = min(len(rest), len(child.path))
            differ = np.flatnonzero(rest[:short] != child.path[:short])
            same = int(differ[0]) if len(differ) else short
            if same < len(child.path):
                upper = _Node(child.path[:same], child.low, child.high, child.tag, [], {int(child.path[same]): child})
                child.path = child.path[same:]
                node.below[int(rest[0])] = child = upper
            child.low, child.high = min(child.low, n), max(child.high, n)
            if child.tag is not None and find(child.tag) != find(me):
                child.tag = None
            rest, node = rest[same:], child

    for me in np.argsort(size, kind="stable").tolist():
        mine, n = ordered[me], size[me]
        marked[mine] = True
        stack = [(child, 0, 0) for child in root.below.values()]
        while stack:
            node, overlap, length = stack.pop()
            if node.tag is not None and find(node.tag) == find(me):
                continue
            overlap += int(np.count_nonzero(marked[node.path]))
            length += len(node.path)
            left = n - int(np.searchsorted(mine, node.path[-1], "right"))
            best = min(max(length + left, node.low), node.high)
            if (100 + percent) * (overlap + min(left, best - length)) < percent * (n + best):
                continue
            for other in node.leaves:
                if (100 + percent) * overlap >= percent * (n + size[other]) and find(other) != find(me):
                    links.append((other, me))
                    parent[find(me)] = find(other)
            stack.extend((child, overlap, length) for child in node.below.values())
        marked[mine] = False
        insert(me)
    return links


def _group_links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, group in rows.groupby(["cc", "part"], sort=False):
            group = group.drop_duplicates("cls")
            ids = group["cls"].tolist()
            found += [(ids[i], ids[j]) for i, j in trie_links(group["grams"].tolist(), percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _grouped(docs: DataFrame, percent: int, width: int, chunk: int, elements: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, t, n, component)`` of every row; t is the hash of the text, component null for the empty set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    sets = scratch.table(docs.mapInArrow(_set_rows(percent, width), "doc_id long, t long, n long, d1 long, d2 long, prefix array<long>"), "sets")
    # Equal sets are one class; its texts may share a doc_id with texts of other classes.
    classes = sets.filter("d1 is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "t")).alias("one"), F.max("n").alias("n"))
    classes = scratch.table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    short = F.col("d1").bitwiseAND(F.lit(_ID_BITS))

    # 1. Prefixes in hash order: sets that share too few elements with others can't link.
    held = _held(sets.filter("prefix is not null").select(F.explode("prefix").alias("h"), short.alias("d")), scratch)
    least = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * percent / 100) / 10))
    alive = held.distinct().groupBy("d").agg(F.count("*").alias("s")).join(classes.withColumn("d", short), "d").filter(F.col("s") >= least).select("cls", "one.doc_id", "one.t")
    alive = scratch.table(alive.select("cls", F.col("doc_id").alias("_id"), F.col("t").alias("_t")), "alive")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    chosen = docs.join(F.broadcast(alive) if alive.count() <= BROADCAST_ROWS else alive, same).select("cls", "text").dropDuplicates(["cls"])
    full = scratch.table(chosen.mapInArrow(_full_rows(width), "cls long, grams array<long>"), "full")

    # 2. Whole sets of those left, rarest elements first.
    held = scratch.table(_held(full.select(F.explode("grams").alias("h"), F.col("cls").alias("d")), scratch), "held")
    need = F.ceil(F.col("n") * percent / 100)
    take = held.groupBy("d").agg(F.count("*").alias("s")).join(full.select(F.col("cls").alias("d"), F.size("grams").alias("n")), "d")
    take = take.filter(F.col("s") >= need).select("d", (F.col("s") - need + 1).alias("take"))
    rare = held.join(take, "d").withColumn("at", F.row_number().over(Window.partitionBy("d").orderBy("df", "h"))).filter("at <= take").select("h", "d")
    rare = scratch.table(rare, "rare")
    centre = scratch.table(rare.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("z")).filter("a < z").select("h", "a"), "centre")
    groups = connected_components(rare.join(centre, "h").filter("a <> d").select("a", F.col("d").alias("b")), scratch)

    # 3. Tries over the candidate groups, cut by sets and by elements.
    member = groups.select(F.col("node").alias("cls"), F.col("component").alias("cc")).join(full.select("cls", F.size("grams").cast("long").alias("n")), "cls")
    member = scratch.table(member, "member")
    sizes = member.groupBy("cc").agg(F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / elements)).alias("parts"))
    member = scratch.table(member.join(sizes, "cc").select("cc", "cls", "n", "parts", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("string").alias("part")), "parts")

    size = member.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    buckets = max(1, size["k"] // GROUP_SETS, size["n"] // GROUP_ELEMENTS)

    def tried(keys: DataFrame) -> DataFrame:
        """Small groups share buckets; a chunk of a large one is a bucket of its own."""
        bucket = F.when(F.col("parts") > 1, F.xxhash64("cc", "part")).otherwise(F.pmod(F.xxhash64("cc"), F.lit(buckets)))
        return full.join(keys, "cls").groupBy(bucket.alias("bucket")).applyInPandas(_group_links(percent), "a long, b long")

    links = scratch.table(tried(member.select("cc", "part", "parts", "cls")), "links")
    large = member.filter("parts > 1")
    if not large.isEmpty():
        for step in (_leaders, _rest):
            label = connected_components(links, scratch).select(F.col("node").alias("cls"), "component")
            state = scratch.table(large.join(label, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "state")
            keys = scratch.table(step(state, chunk, elements).withColumn("parts", F.lit(2)), "keys")
            links = scratch.table(links.unionAll(tried(keys)), "links")
    label = connected_components(links, scratch).select(F.col("node").alias("cls"), "component")
    named = classes.join(label, "cls", "left").select("d1", "d2", F.coalesce("component", "cls").alias("component"))
    return sets.select("doc_id", "t", "n", "d1", "d2").join(named, ["d1", "d2"], "left").select("doc_id", "t", "n", "component")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, chunk: int = CHUNK, elements: int = ELEMENTS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    Rows link when ``100 * |A & B| >= percent * |A | B|`` of their shingle sets;
    component_id is the smallest doc_id reachable, the own one (null too) of a
    row that links with nothing.  Null and blank texts have the empty set and
    link with nothing; texts of fewer than ``width`` words are one shingle; texts
    of any length are read whole.  Repeated rows each come back, and texts that
    share a doc_id are judged apart; other columns are ignored.  An empty table
    gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    found = scratch.table(_grouped(docs, percent, width, chunk, elements, scratch), "grouped")
    first = found.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("first"))
    first = scratch.table(first, "first")  # stored, so that Spark can split a large component's rows
    return found.join(first, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, chunk: int = CHUNK, elements: int = ELEMENTS) -> DataFrame:
    """The rows of ``docs`` left when one row of each group of near duplicates stays.

    That is the row with the smallest (doc_id, hash of the text), null ids last; of
    rows that repeat both, any one.  Rows are judged by doc_id and text together,
    so another text of a removed row's doc_id is not touched.  Rows without words
    all stay.  All columns stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    found = scratch.table(_grouped(docs, percent, width, chunk, elements, scratch).filter("component is not null"), "grouped")
    texts = found.groupBy("component", "doc_id", "t").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    keep = texts.groupBy("component").agg(F.min(order).alias("k"))
    judged = texts.join(scratch.table(keep, "keep"), "component").withColumn("stays", order == F.col("k"))
    judged = scratch.table(judged.filter("rows > 1 or not stays").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "stays"), "judged")
    few = judged.count() <= BROADCAST_ROWS
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_t"))
    rest = docs.join(F.broadcast(judged) if few else judged, same, "left_anti")
    again = judged.filter("stays")
    if again.isEmpty():
        return rest
    once = docs.join(F.broadcast(again) if few else again, same, "left_semi").withColumns({"_id": F.col("doc_id").cast("long"), "_t": F.xxhash64("text")}).dropDuplicates(["_id", "_t"]).drop("_id", "_t")
    return rest.unionByName(once)
