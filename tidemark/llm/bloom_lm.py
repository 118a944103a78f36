"""Language-model scoring with a log-frequency Bloom filter.

Training texts are counted as words (plus one end a text) and pairs of
neighbours.  A count is quantised to a level of a geometric scale, and the
filter holds (n-gram, level) for every level up to it, counts of one included;
a count is read back by probing level after level until one is missing.  The
filter is blocked: a probe reads one 64-bit word and asks for ``PROBES`` bits of
it.  It is cut into segments by hash, so that one task builds a segment from its
own keys and no filters are merged.

Memory is fixed: the filter has ``bits_per_key`` bits for each (n-gram, level),
and ``filter_bytes`` at most.  A missing pair is read as present with a chance
of about 1 % at 12 bits a key and 4 % at 8; beyond ``filter_bytes`` fewer bits
are left for each and the error grows, about 20 % at 4 bits and 60 % at 2.  No
n-gram is left out.  ``filter_bytes`` is what to raise for larger corpora.

The model interpolates by absolute discounting: a word after another has the
pair's count less ``delta``, over the context's count, plus the mass so freed
times the smoothed share of the word.  ``delta`` is n1 / (n1 + 2 n2) of the
pairs seen once and twice.  The mass follows from the distinct followers of a
context, summed over all training tokens by the level of the context.

Exact word counts, for the add-half base score, come from a broadcast table of
at most ``table_words`` words, the most frequent ones.  If there are more, the
tokens not found are joined with the counts of the other words by shuffle; each
of these is rare, so no key is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hashing
from tidemark.llm.store import Scratch, small_batches

BITS_PER_KEY = 12
FILTER_BYTES = 192 << 20
TABLE_WORDS = 2_000_000
BUCKET_BYTES = 8 << 20
PROBES = 4
SCALE = 1.5
LEVELS = 112
START_ROW = LEVELS - 1
FLUSH = 1_500_000
MERGE = 2_000_000
PIECE = 200_000
SLICE = 1 << 20
SENT_BYTES = 16 << 20

_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x9FB21C651E98DF25)
_LEFT, _RIGHT, _LEVEL = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(SCALE) + 1e-9).astype(np.int64)


def _typical() -> np.ndarray:
    """The middle of the whole numbers of each level; 0 for level 0."""
    edges = np.ceil(SCALE ** np.arange(LEVELS + 1) - 1e-9)
    return np.concatenate([[0.0], (edges[:-1] + np.maximum(edges[1:] - 1, edges[:-1])) / 2])


TYPICAL = _typical()


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and each text's first token (one more at the end)."""
    word, first = hashing.word_hashes(column)
    n = len(column)
    out = np.empty(len(word) + n, np.uint64)
    ends = first[1:] + np.arange(n)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside], out[ends] = word, _END
    return out, first + np.arange(n + 1)


def _pairs(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Key of each token with its predecessor; the 16 low bits are cut off."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first[:-1]] = _START
    return hashing.mix(before * _LEFT + token * _RIGHT) & np.uint64(0xFFFFFFFFFFFF0000)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, n
    order = np.argsort(key)
    key, n = key[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[edge], np.add.reduceat(n, edge)


def _packed(key: np.ndarray, gram: int) -> bytes:
    return key.tobytes() if gram == 1 else np.ascontiguousarray((key >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes, gram: int) -> np.ndarray:
    if gram == 1:
        return np.frombuffer(data, np.uint64)
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel() << np.uint64(16)


_COUNTS = "bucket int, gram int, ones binary, keys binary, counts binary"


def _count_rows(bucket_bits: int):
    """By bucket and order: the keys seen once, and the others with their counts, of a stretch of texts."""
    shift, n_buckets = np.uint64(64 - bucket_bits), 1 << bucket_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _READERS.clear()  # of an earlier call, in a worker used again
        kept: dict[int, tuple[list, list]] = {1: ([], []), 2: ([], [])}
        held = {1: 0, 2: 0}

        def flush(gram: int) -> Iterator[pa.RecordBatch]:
            key, n = _merge(*kept[gram])
            kept[gram], held[gram] = ([], []), 0
            edge = np.searchsorted(key >> shift, np.arange(n_buckets + 1, dtype=np.uint64))
            some = np.flatnonzero(edge[:-1] < edge[1:])
            for at in range(0, len(some), 1024):
                rows: list[tuple] = []
                for b in some[at : at + 1024]:
                    k, c = key[edge[b] : edge[b + 1]], n[edge[b] : edge[b + 1]]
                    once = c == 1
                    rows.append((_packed(k[once], gram), _packed(k[~once], gram), c[~once].astype(np.uint32).tobytes()))
                columns = [pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 1024], pa.int32()), pa.array([gram] * len(rows), pa.int32()), *columns], names=["bucket", "gram", "ones", "keys", "counts"])

        def add(gram: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            kept[gram][0].append(key)
            kept[gram][1].append(n)
            held[gram] += len(key)
            if held[gram] >= FLUSH:
                key, n = _merge(*kept[gram])
                kept[gram], held[gram] = ([key], [n]), len(key)
                if len(key) >= FLUSH // 2:
                    yield from flush(gram)

        for whole in batches:
            for batch in hashing.slices(whole, "text", SLICE):
                token, first = _tokens(batch.column("text"))
                for gram, key in ((1, token), (2, _pairs(token, first))):
                    yield from add(gram, *np.unique(key, return_counts=True))
            hashing.trim()
        for gram in (1, 2):
            yield from flush(gram)
        hashing.trim()

    return run


def _places(key: np.ndarray, level: np.ndarray | int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of its segment, and the bits of it, that a key has at a level."""
    h = hashing.mix(key + np.asarray(level, np.uint64) * _LEVEL)
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(32)) * size) >> np.uint64(32), bits


def _segment(keys: np.ndarray, high: np.ndarray, bits_per_key: float, most_words: int) -> np.ndarray:
    """A filter of levels 1 to ``high`` of each key, as 64-bit words."""
    key = np.repeat(keys, high)
    level = np.arange(len(key)) - np.repeat(np.cumsum(high) - high, high) + 1
    size = max(1, min(most_words, round(len(key) * bits_per_key / 64)))
    table = np.zeros(size, np.uint64)
    for at in range(0, len(key), PIECE):
        place, bits = _places(key[at : at + PIECE], level[at : at + PIECE], np.uint64(size))
        np.bitwise_or.at(table, place, bits)
    return table


_REDUCED = "bucket int, segment binary, words binary, counts binary, size long, n_words long, n_tokens long, n_texts long, once long, twice long, levels array<long>"


def _reduce_rows(bits_per_key: float, most_words: int):
    """From rows sorted by bucket: its filter segment and the exact counts of its words."""

    def done(bucket: int, kept: dict) -> pa.RecordBatch:
        (word, n), (pair, m) = _merge(*kept[1]), _merge(*kept[2])
        level = level_of(n)
        table = _segment(np.concatenate([word, pair]), np.concatenate([level, level_of(m)]), bits_per_key, most_words)
        row = {
            "bucket": bucket, "segment": table.tobytes(), "words": word.tobytes(), "counts": n.tobytes(), "size": len(table), "n_words": len(word), "n_tokens": int(n.sum()), "n_texts": int(n[word == _END].sum()),
            "once": int((m == 1).sum()), "twice": int((m == 2).sum()), "levels": np.bincount(level, minlength=LEVELS).tolist(),
        }
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("segment", "words", "counts")), *((c, pa.int64()) for c in ("size", "n_words", "n_tokens", "n_texts", "once", "twice")), ("levels", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, kept, held = None, {1: ([], []), 2: ([], [])}, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    if bucket is not None:
                        yield done(bucket, kept)
                    bucket, kept, held = row["bucket"], {1: ([], []), 2: ([], [])}, 0
                    hashing.trim()
                gram = row["gram"]
                once, more = _unpacked(row["ones"], gram), _unpacked(row["keys"], gram)
                kept[gram][0].extend((once, more))
                kept[gram][1].extend((np.ones(len(once), np.int64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)))
                held += len(once) + len(more)
                if held >= MERGE:
                    kept = {g: tuple([x] for x in _merge(*kept[g])) for g in kept}
                    held = 0
        if bucket is not None:
            yield done(bucket, kept)

    return run


class Filter:
    """The segments of all buckets, ready for probing; they have ``n_words`` 64-bit words if these are known before."""

    def __init__(self, segments: Iterable[tuple[int, bytes]], bucket_bits: int, n_words: int | None = None):
        if n_words is None:
            segments = list(segments)
            n_words = sum(len(data) for _, data in segments) // 8
        self.shift = np.uint64(64 - bucket_bits)
        self.size, self.start = np.ones(1 << bucket_bits, np.uint64), np.zeros(1 << bucket_bits, np.uint64)
        self.data, at = np.zeros(n_words + 1, np.uint64), 1  # an absent bucket reads the empty word
        for bucket, data in segments:
            part = np.frombuffer(data, np.uint64)
            self.size[bucket], self.start[bucket] = len(part), at
            self.data[at : at + len(part)] = part
            at += len(part)

    def level(self, key: np.ndarray) -> np.ndarray:
        """The highest level reached without a gap, by repeated probes; 0 if the first is missing."""
        found = np.zeros(len(key), np.int64)
        bucket = (key >> self.shift).astype(np.int64)
        live, start, size = np.arange(len(key)), self.start[bucket], self.size[bucket]
        for level in range(1, START_ROW):
            place, bits = _places(key, level, size)
            hit = (self.data[start + place] & bits) == bits
            live, key, start, size = live[hit], key[hit], start[hit], size[hit]
            if not len(live):
                break
            found[live] = level
        return found


@dataclass
class Sent:
    """A filter on its way to the workers: broadcasts of about ``SENT_BYTES``, of which the driver holds one at a time."""

    pieces: list[Broadcast]
    bucket_bits: int
    n_words: int

    @classmethod
    def of(cls, reduced: DataFrame, bucket_bits: int, n_words: int) -> Sent:
        """From ``reduced(bucket, segment)``, whose buckets have about equally many of the words."""
        pieces, step = [], max(1, (SENT_BYTES << bucket_bits) // max(1, 8 * n_words))
        for low in range(0, 1 << bucket_bits, step):
            found = reduced.filter(F.col("bucket").between(low, low + step - 1)).select("bucket", "segment").toArrow()
            pieces.append(reduced.sparkSession.sparkContext.broadcast(list(zip(found["bucket"].to_pylist(), found["segment"].to_pylist(), strict=True))))
            del found
            hashing.trim()
        return cls(pieces, bucket_bits, n_words)

    def segments(self) -> Iterator[tuple[int, bytes]]:
        for piece in self.pieces:
            yield from piece.value
            if getattr(piece, "_path", None):  # it can be read again, and a worker keeps the filter itself
                vars(piece).pop("_value", None)

    def filter(self) -> Filter:
        return Filter(self.segments(), self.bucket_bits, self.n_words)


class Words:
    """Exact counts of words: sorted hashes with an index by their leading bits."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        order = np.argsort(key)
        self.key, self.count = key[order], count[order]
        bits = max(1, int(len(key)).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        lead = np.bincount((self.key >> self.shift).astype(np.int32), minlength=1 << bits) if len(key) else np.zeros(1 << bits, np.int64)
        self.first = np.concatenate([[0], np.cumsum(lead)]).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key in ``key``, -1 if absent."""
        found = np.full(len(key), -1, np.int64)
        lead = (key >> self.shift).astype(np.int64)
        live, at, end = np.arange(len(key)), self.first[lead].astype(np.int64), self.first[lead + 1]
        while len(live):
            inside = at < end
            live, at, end = live[inside], at[inside], end[inside]
            here, mine = self.key[at], key[live]
            same = here == mine
            found[live[same]] = at[same]
            more = here < mine
            live, at, end = live[more], at[more] + 1, end[more]
        return found


@dataclass
class Reader:
    """What a worker reads counts from; the levels of the table's words are probed once a process."""

    filter: Filter
    words: Words
    levels: np.ndarray

    @classmethod
    def of(cls, token: str, sent: Sent, words: Broadcast) -> Reader:
        if token not in _READERS:
            _READERS.clear()
            f, w = sent.filter(), words.value
            levels = np.concatenate([np.empty(0, np.uint8), *(f.level(w.key[i : i + PIECE]).astype(np.uint8) for i in range(0, len(w.key), PIECE))])
            hashing.trim()
            _READERS[token] = cls(f, w, levels)
        return _READERS[token]

    def of_words(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table (-1: not in it) and filter level of each token."""
        place = self.words.find(token)
        level = self.levels[np.maximum(place, 0)].astype(np.int64) if len(self.levels) else np.zeros(len(token), np.int64)
        away = np.flatnonzero(place < 0)
        level[away] = self.filter.level(token[away])
        return place, level


_READERS: dict[str, Reader] = {}


def _context_levels(level: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(level)
    out[1:] = level[:-1]
    out[first[:-1]] = START_ROW
    return out


def _follower_rows(token_: str, sent: Sent, words: Broadcast):
    """Tokens, and distinct pairs as far as their counts say, by the level of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(token_, sent, words)
        table = np.zeros((2, LEVELS))
        for whole in batches:
            for batch in hashing.slices(whole, "text", SLICE):
                token, first = _tokens(batch.column("text"))
                context = _context_levels(reader.of_words(token)[1], first)
                count = TYPICAL[reader.filter.level(_pairs(token, first))]
                table[0] += np.bincount(context, minlength=LEVELS)
                table[1] += np.bincount(context, 1 / np.maximum(count, 1), minlength=LEVELS)
            hashing.trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(table[0]), pa.array(table[1])], names=["level", "n", "distinct"])

    return run


@dataclass
class Model:
    """Totals of the training texts and the back-off mass by the level of the context."""

    n_tokens: int
    n_types: int
    n_texts: int
    delta: float
    mass: np.ndarray

    @property
    def total(self) -> float:
        return self.n_tokens + 0.5 * (self.n_types + 1)

    def log10(self, level: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 p of tokens of a level after a context's level, with their pair's level."""
        single = (TYPICAL[level] + 0.5) / self.total
        count = np.where(context == START_ROW, float(self.n_texts), TYPICAL[context])
        known = count > 0
        share = np.where(known, np.maximum(np.minimum(TYPICAL[pair], count) - self.delta, 0.0) / np.maximum(count, 1.0), 0.0)
        return np.log10(np.minimum(share + np.where(known, self.mass[context], 1.0) * single, 1.0))


_SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, rare_n array<int>"


def _score_rows(token_: str, sent: Sent, words: Broadcast, model: Model, whole_table: bool):
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "rare_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(token_, sent, words)
        counts = reader.words.count
        total = np.log10(model.total)
        for whole in batches:
            for batch in hashing.slices(whole, "text", SLICE):
                token, first = _tokens(batch.column("text"))
                n = batch.num_rows
                owner = np.repeat(np.arange(n), np.diff(first))
                place, level = reader.of_words(token)
                c = counts[np.maximum(place, 0)] * (place >= 0) if len(counts) else np.zeros(len(token), np.int64)
                base = np.where((place >= 0) | whole_table, np.log10(c + 0.5) - total, 0.0)
                logs = model.log10(level, _context_levels(level, first), reader.filter.level(_pairs(token, first)))
                rare, many, start = np.empty(0, np.int64), np.empty(0, np.int32), np.zeros(n + 1, np.int32)
                if not whole_table:
                    away = np.flatnonzero(place < 0)
                    each = np.stack([owner[away].astype(np.uint64), token[away]], axis=1)
                    pair, many = np.unique(each, axis=0, return_counts=True) if len(each) else (np.empty((0, 2), np.uint64), many)
                    start = np.searchsorted(pair[:, 0], np.arange(n + 1, dtype=np.uint64)).astype(np.int32)
                    rare, many = np.ascontiguousarray(pair[:, 1]).view(np.int64), many.astype(np.int32)
                sums = [np.bincount(owner, x, minlength=n) for x in (c > 0, base, logs)]
                lists = [pa.ListArray.from_arrays(pa.array(start), pa.array(x)) for x in (rare, many)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *lists], names=names
                )
            hashing.trim()

    return run


def _exact_rows(least: int, below: bool):
    """``(word, n)`` of the words whose count has a level of ``least`` or more, or (``below``) a lower one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, n = np.frombuffer(row["words"], np.int64), np.frombuffer(row["counts"], np.int64)
                some = (level_of(n) < least) if below else (level_of(n) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(word[some]), pa.array(n[some])], names=["word", "n"])

    return run


def score_texts(docs: DataFrame, table_words: int = TABLE_WORDS, filter_bytes: int = FILTER_BYTES, bits_per_key: float = BITS_PER_KEY) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``docs(doc_id, text)``.

    Texts whose crc32 of doc_id (as text, null as empty) mod 5 is 1 are held out
    of the counts.  A null or blank text is one end; a text of any length is
    scored whole, some megabytes at a time go through a worker's arrays unless a
    single text is longer.  Repeated rows each come back; other columns are
    ignored; of an empty table an empty one is made, without training texts every
    token scores as unseen.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bloom-lm")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    training = rows.filter("not held_out").select("text")
    n_bytes = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bits = min(16, max(6, (n_bytes // BUCKET_BYTES).bit_length()))
    counted = training.mapInArrow(_count_rows(bucket_bits), _COUNTS).repartition("bucket").sortWithinPartitions("bucket")
    reduced = scratch.table(counted.mapInArrow(_reduce_rows(bits_per_key, max(1, filter_bytes // 8 >> bucket_bits)), _REDUCED), "reduced")

    sums = reduced.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "n_words", "n_tokens", "n_texts", "once", "twice")]).first()
    by_level = {r["level"]: r["n"] for r in reduced.select(F.posexplode("levels").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()}  # LEVELS rows
    least, held = LEVELS, 0
    while least > 0 and held + by_level.get(least - 1, 0) <= table_words:
        least -= 1
        held += by_level.get(least, 0)
    exact = reduced.select("words", "counts").mapInArrow(_exact_rows(least, False), "word long, n long").toArrow()  # table_words rows at most
    word, n = exact["word"].to_numpy().view(np.uint64), exact["n"].to_numpy()
    del exact
    n = n.astype(np.uint32) if n.max(initial=0) < 1 << 32 else n
    words = spark.sparkContext.broadcast(Words(word, n))
    del word, n
    hashing.trim()
    sent = Sent.of(reduced, bucket_bits, int(sums["size"]))  # filter_bytes at most
    token = uuid.uuid4().hex

    followers = training.mapInArrow(_follower_rows(token, sent, words), "level long, n double, distinct double").groupBy("level").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"))
    with small_batches(spark):
        followers = followers.collect()  # LEVELS rows
    delta = sums["once"] / (sums["once"] + 2 * sums["twice"]) if sums["once"] else 0.5
    mass = np.ones(LEVELS)
    for r in followers:
        mass[r["level"]] = delta * r["distinct"] / r["n"] if r["n"] else 1.0
    model = Model(int(sums["n_tokens"]), int(sums["n_words"]), int(sums["n_texts"]), delta, mass)
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(_score_rows(token, sent, words, model, least == 0), _SCORED)
    if least > 0:
        scored = scratch.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        tokens = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("k"))
        others = reduced.select("words", "counts").mapInArrow(_exact_rows(least, True), "word long, n long")
        c = F.coalesce("n", F.lit(0))
        added = tokens.join(others, "word", "left").groupBy("row").agg(
            F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * (F.log10(c + 0.5) - F.lit(float(np.log10(model.total))))).alias("more_base")
        )
        scored = scored.join(added, "row", "left").withColumns({"known": F.col("known") + F.coalesce("more_known", F.lit(0)), "base": F.col("base") + F.coalesce("more_base", F.lit(0.0))})
    scored = scored.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
    scored = scratch.table(scored, "result")
    for shared in (words, *sent.pieces):  # the stored scores need them no more, on the driver neither
        shared.destroy()
    return scored
