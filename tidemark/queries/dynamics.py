"""Embedding, simplex and cross-map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import DRIVER
from tidemark.operators import embedding as E
from tidemark.operators.search import nearest_vectors
from tidemark.queries.base import Query, sql
from tidemark.queries.panels import stored_anomaly as anomaly
from tidemark.sources import tables as T

LAGS = tuple(range(-3, 4))


def _embedding(spark, sf):
    rows = E.delay_embedding(anomaly(spark, sf), "WL", 3, 1, 2).filter("P is not null")
    return rows.select("entity", "month", F.round("P", 2).alias("cause"), *[F.round(F.col("emb")[k], 2).alias(f"emb{k}") for k in range(3)])


def _simplex(spark, sf):
    s = E.simplex(anomaly(spark, sf), "WL", DRIVER.embed_dims)
    return s.select("entity", F.col("E").cast("long").alias("dim"), F.round("rho", 6).alias("rho"), "n")


def _select(spark, sf):
    s = E.select_dimension(E.simplex(anomaly(spark, sf), "RegFlow", DRIVER.embed_dims))
    return s.select("entity", F.col("E").cast("long").alias("dim"), F.round("rho", 6).alias("rho"))


def _ccm(spark, sf):
    s = E.cross_map(anomaly(spark, sf), "P", "WL", 3, 1, [0])
    return s.select("entity", F.round("rho", 6).alias("rho"), "n")


def _scan(spark, sf):
    s = E.cross_map(anomaly(spark, sf), "RegFlow", "WL", 2, 1, LAGS)
    return s.select("entity", F.col("lag").cast("long").alias("lag"), F.round("rho", 6).alias("rho"), "n")


def _best(spark, sf):
    s = E.best_lag(E.cross_map(anomaly(spark, sf), "RegFlow", "WL", 2, 1, LAGS))
    return s.select("entity", F.col("obs_lag").cast("long").alias("obs_lag"), F.round("obs_rho", 6).alias("obs_rho"), "obs_n")


def _constrained(spark, sf):
    """Only lags a forecast may use: 1 and more."""
    s = E.best_lag(E.cross_map(anomaly(spark, sf), "SWE", "WL", 2, 1, (1, 2, 3, 4)))
    return s.select("entity", F.col("obs_lag").cast("long").alias("obs_lag"), F.round("obs_rho", 6).alias("obs_rho"))


def _convergence(spark, sf):
    c = E.prefix_convergence(anomaly(spark, sf), "P", "WL", 2, 1, (15, 30, 45, 60))
    return c.select("entity", F.col("size").cast("long").alias("lib_size"), F.round("rho", 6).alias("rho"))


def _knn_vectors(spark, sf):
    """Three nearest vectors of every vector whose id is divisible by 20, over all vectors, by Euclidean distance."""
    near = nearest_vectors(T.table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 3)
    return near.select("query", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("d", 6).alias("d"))



def _skill_sql(dim: int, keys: str, radius: int = 0, extra: str = "") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    dist = " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(dim))
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""d AS (SELECT {ks}, a.t, a.y, b.t AS lt, b.y AS ly, sqrt({dist}) AS d FROM r a JOIN r b ON {on} AND abs(a.t - b.t) > {radius} {extra}),
        k AS (SELECT *, row_number() OVER (PARTITION BY {keys}, t ORDER BY d, lt) AS rk FROM d),
        f AS (SELECT *, exp(-d / greatest(min(d) OVER (PARTITION BY {keys}, t), 1e-6)) AS w FROM k WHERE rk <= {dim + 1}),
        p AS (SELECT {keys}, t, max(y) AS y, sum(w * ly) / sum(w) AS p FROM f GROUP BY ALL),
        s AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(y) > 0 AND stddev_pop(p) > 0 THEN corr(y, p) END AS rho FROM p GROUP BY {keys})"""


def _lags_sql(cause: str, dim: int, lags) -> str:
    cols = ", ".join(f"CASE l " + " ".join(f"WHEN {g} THEN lag(WL, {k - g}) OVER w" if k - g >= 0 else f"WHEN {g} THEN lead(WL, {g - k}) OVER w" for g in lags) + f" END AS e{k}" for k in range(dim))
    full = " AND ".join(f"e{k} IS NOT NULL" for k in range(dim))
    values = ", ".join(f"({g})" for g in lags)
    return f"""x AS (SELECT entity, l AS lag, t, {cause} AS y, {cols} FROM anomaly, (VALUES {values}) v(l) WINDOW w AS (PARTITION BY entity, l ORDER BY t)),
        r AS (SELECT * FROM x WHERE y IS NOT NULL AND {full} QUALIFY count(*) OVER (PARTITION BY entity, lag) >= {max(20, dim + 5)})"""


def _simplex_sql(column: str) -> str:
    parts = []
    for dim in DRIVER.embed_dims:
        cols = ", ".join(f"lag({column}, {k}) OVER w AS e{k}" for k in range(dim))
        full = " AND ".join(f"e{k} IS NOT NULL" for k in range(dim))
        parts.append(f"""(WITH x AS (SELECT entity, t, lead({column}) OVER w AS y, {cols} FROM anomaly WINDOW w AS (PARTITION BY entity ORDER BY t)),
            r AS (SELECT * FROM x WHERE y IS NOT NULL AND {full}), {_skill_sql(dim, 'entity', 1)} SELECT entity, {dim}::BIGINT AS dim, rho, n FROM s)""")
    return " UNION ALL ".join(parts)


_TOP = "SELECT entity, {c} FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY -rho, lag) AS k FROM s WHERE rho IS NOT NULL) WHERE k = 1"

QUERIES = {
    "delay_embedding": Query(_embedding, sql("""
        WITH x AS (SELECT entity, month, P, lead(WL, 2) OVER w AS e0, lead(WL, 1) OVER w AS e1, WL AS e2 FROM anomaly WINDOW w AS (PARTITION BY entity ORDER BY t))
        SELECT entity, month, round(P, 2) AS cause, round(e0, 2) AS emb0, round(e1, 2) AS emb1, round(e2, 2) AS emb2 FROM x
        WHERE P IS NOT NULL AND e0 IS NOT NULL AND e1 IS NOT NULL AND e2 IS NOT NULL""", "anomaly")),
    "simplex_skill": Query(_simplex, sql(f"WITH q AS ({_simplex_sql('WL')}) SELECT entity, dim, round(rho, 6) AS rho, n FROM q", "anomaly")),
    "select_dimension": Query(_select, sql(f"""WITH q AS ({_simplex_sql('RegFlow')}), o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY -rho, dim) AS k FROM q WHERE rho IS NOT NULL)
        SELECT entity, dim, round(rho, 6) AS rho FROM o WHERE k = 1""", "anomaly")),
    "ccm_full_library": Query(_ccm, sql(f"WITH {_lags_sql('P', 3, [0])}, {_skill_sql(3, 'entity, lag')} SELECT entity, round(rho, 6) AS rho, n FROM s", "anomaly")),
    "ccm_lag_scan": Query(_scan, sql(f"WITH {_lags_sql('RegFlow', 2, LAGS)}, {_skill_sql(2, 'entity, lag')} SELECT entity, lag::BIGINT AS lag, round(rho, 6) AS rho, n FROM s", "anomaly")),
    "ccm_max_over_lags": Query(_best, sql(f"WITH {_lags_sql('RegFlow', 2, LAGS)}, {_skill_sql(2, 'entity, lag')} " + _TOP.format(c="lag::BIGINT AS obs_lag, round(rho, 6) AS obs_rho, n AS obs_n"), "anomaly")),
    "constrained_lag": Query(_constrained, sql(f"WITH {_lags_sql('SWE', 2, (1, 2, 3, 4))}, {_skill_sql(2, 'entity, lag')} " + _TOP.format(c="lag::BIGINT AS obs_lag, round(rho, 6) AS obs_rho"), "anomaly")),
    "ccm_convergence": Query(_convergence, sql(f"""WITH {_lags_sql('P', 2, [0])}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS at FROM r),
        r2 AS (SELECT n.*, z AS size FROM n, (VALUES (15), (30), (45), (60)) v(z)), {_skill_sql(2, 'entity, size', 0, 'AND b.at <= b.size').replace('FROM r a JOIN r b', 'FROM r2 a JOIN r2 b')}
        SELECT entity, size::BIGINT AS lib_size, round(rho, 6) AS rho FROM s""", "anomaly")),
    "knn_vectors": Query(_knn_vectors, """
        WITH p AS (SELECT a.vec_id AS query, b.vec_id, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: power(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS d
                   FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM p)
        SELECT query, rank, vec_id, round(d, 6) AS d FROM k WHERE rank <= 3"""),
}
