"""Exact nearest vectors: blocks of both sides meet once, products bound the distances, exact ones rank what is left.

No pair becomes a row: a task gets a block of vectors and one of asked vectors and
returns the nearest of its own, which are ranked again over all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDE = 16_384
BLOCKS = 32
PAIRS = 1 << 21


def _width(table: pa.Table) -> int:
    return pc.max(pc.list_value_length(table["emb"])).as_py() or 0


def _vectors(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components (0 where there is none) and which components there are."""
    emb = pa.concat_arrays(table["emb"].chunks)
    length = pc.fill_null(pc.list_value_length(emb), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    parts = emb.flatten()
    x, has = np.zeros((len(length), width)), np.zeros((len(length), width), bool)
    x[row, place] = pc.fill_null(parts, 0.0).to_numpy(zero_copy_only=False)
    has[row, place] = parts.is_valid().to_numpy(zero_copy_only=False)
    return table["vec_id"].to_numpy(), x, has


def _since(new: np.ndarray) -> np.ndarray:
    """How many places after the last true one."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _few_copies(ids: np.ndarray, x: np.ndarray, has: np.ndarray, k: int) -> np.ndarray:
    """Of equal vectors those with the smallest ids, an id up to k times: k of them have another id than the asked one."""
    whole = np.ascontiguousarray(np.hstack([x.view(np.uint8).reshape(len(x), -1), has.view(np.uint8)]))
    cls = np.unique(whole.view(np.dtype((np.void, whole.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, cls))
    c, i = cls[order], ids[order]
    other = np.append(True, c[1:] != c[:-1])
    order, c = (a[_since(other | np.append(True, i[1:] != i[:-1])) < k] for a in (order, c))
    return order[_since(np.append(True, c[1:] != c[:-1])) < 2 * k]


def _within(q: np.ndarray, x: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Pairs that may be among the k nearest of their row, by squares and products with a bound of their rounding."""
    norms = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)
    square = norms - 2 * (q @ x.T)
    slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps * norms + 1e-300
    limit = np.partition(np.where(other, square + slack, np.inf), k - 1, axis=1)[:, [k - 1]] if len(x) > k else np.inf
    return other & (square - slack <= limit)


def nearest_of(q_id, q, q_has, x_id, x, x_has, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Asked id, vector id, distance and whether there is one: the k nearest of each asked vector or a few more.

    Components that either side lacks are left out, and pairs without any common
    one come last; NaN is the largest distance; ties go by id.
    """
    keep = _few_copies(x_id, x, x_has, k)
    x_id, x, x_has = x_id[keep], x[keep], x_has[keep]
    plain_q, plain_x = (has.all(axis=1) & (np.abs(a) < 1e100).all(axis=1) for a, has in ((q, q_has), (x, x_has)))
    found = [(q_id[:0], x_id[:0], np.empty(0), np.empty(0, bool))]
    for asked, there, plain in ((plain_q, plain_x, True), (plain_q, ~plain_x, False), (~plain_q, np.ones(len(x), bool), False)):
        rows, columns = np.flatnonzero(asked), np.flatnonzero(there)
        step = max(1, PAIRS // max(1, len(columns)))
        for at in range(0, len(rows) if len(columns) else 0, step):
            some = rows[at : at + step]
            near = q_id[some][:, None] != x_id[columns]
            a, b = np.nonzero(_within(q[some], x[columns], near, k) if plain else near)
            i, j = some[a], columns[b]
            total, known = np.zeros(len(i)), np.zeros(len(i), bool)
            with np.errstate(invalid="ignore", over="ignore"):
                for c in range(q.shape[1]):  # summed in order, as a row at a time would be
                    both, gap = q_has[i, c] & x_has[j, c], q[i, c] - x[j, c]
                    total += np.where(both, gap * gap, 0.0)
                    known |= both
            d = np.sqrt(total)
            order = np.lexsort((x_id[j], d, ~known, i))
            i, j, d, known = i[order], j[order], d[order], known[order]
            first = _since(np.append(True, i[1:] != i[:-1])[: len(i)]) < k
            found.append((q_id[i[first]], x_id[j[first]], d[first], known[first]))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _block_rows(k: int):
    names = ["query", "vec_id", "d"]

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        width = max(1, _width(asked), _width(rows))
        query, vec_id, d, known = nearest_of(*_vectors(asked, width), *_vectors(rows, width), k)
        return pa.table([pa.array(query), pa.array(vec_id), pa.array(d, pa.float64(), mask=~known)], names=names)

    return run


def nearest_vectors(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """``(query, vec_id, d, rank)``: the k nearest of each ``asked`` row of ``vectors(vec_id, embedding)`` among rows of other ids."""
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("emb"))
    wanted = rows.filter(asked)
    blocks, parts = max(BLOCKS, -(-rows.count() // SIDE)), max(1, -(-wanted.count() // SIDE))
    at = F.xxhash64("vec_id", "emb")
    left = wanted.withColumns({"part": F.pmod(at, F.lit(parts)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = rows.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "block": F.pmod(at, F.lit(blocks)).cast("int")})
    near = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_block_rows(k), "query long, vec_id long, d double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("d").asc_nulls_last(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)
