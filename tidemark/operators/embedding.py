"""State-space operators: delay embeddings, nearest neighbours, simplex and cross-map skill.

The relational path below is a self-join within a series; ``kernels`` has the
same numbers from one numpy pass a group, for long series and many surrogates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.series import over, shift

FLOOR = 1e-6


def delay_embedding(panel: DataFrame, effect: str, dim: int, tau: int = 1, lag: int = 0, keys: Sequence[str] = ("entity",), time: str = "t") -> DataFrame:
    """``emb[k] = effect(t + lag - k * tau)`` on the complete calendar; rows with a gap are dropped."""
    w = over(keys, time)
    parts = F.array(*[shift(effect, k * tau - lag, w) for k in range(dim)])
    return panel.withColumn("emb", parts).filter(F.forall("emb", lambda x: x.isNotNull()))


def lag_family(panel: DataFrame, cause: str, effect: str, dim: int, tau: int, lags: Sequence[int], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Embeddings at every lag, with the cause as target; lags with too few rows are left out."""
    w = over(keys, "t")
    wide = panel.withColumns({f"_e{j}": shift(effect, -j, w) for j in sorted({lag - k * tau for lag in lags for k in range(dim)})})
    each = [F.struct(F.lit(lag).alias("lag"), F.array(*[F.col(f"_e{lag - k * tau}") for k in range(dim)]).alias("emb")) for lag in lags]
    rows = wide.filter(F.col(cause).isNotNull()).select(*keys, "t", F.col(cause).alias("y"), F.explode(F.array(*each)).alias("l")).select(*keys, "t", "y", "l.*")
    rows = rows.filter(F.forall("emb", lambda x: x.isNotNull()))
    enough = F.count("*").over(Window.partitionBy(*keys, "lag"))
    return rows.withColumn("rows", enough).filter(F.col("rows") >= max(20, dim + 5))


def distance(a, b) -> F.Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(rows: DataFrame, keys: Sequence[str], k: int, radius: int = 0, time: str = "t") -> DataFrame:
    """The k nearest rows of the same series, not within ``radius`` in time; ties by the neighbour's time."""
    left, right = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
    apart = F.abs(F.col(f"a.{time}") - F.col(f"b.{time}")) > radius
    condition = apart
    for s in same:
        condition = condition & s
    pairs = left.join(right, condition).select(
        *[F.col(f"a.{c}").alias(c) for c in keys], F.col(f"a.{time}").alias("t"), F.col("a.y").alias("y"),
        F.col(f"b.{time}").alias("lib_t"), F.col("b.y").alias("lib_y"), distance(F.col("a.emb"), F.col("b.emb")).alias("d"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "t").orderBy("d", "lib_t"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def skill(neighbours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson rho of target and exponentially weighted neighbours' targets; null when undefined."""
    first = F.greatest(F.min("d").over(Window.partitionBy(*keys, "t")), F.lit(FLOOR))
    weighted = neighbours.withColumn("w", F.exp(-F.col("d") / first))
    predicted = weighted.groupBy(*keys, "t").agg(F.max("y").alias("y"), (F.sum(F.col("w") * F.col("lib_y")) / F.sum("w")).alias("p"))
    s = predicted.groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop("y", "p").alias("c"), F.stddev_pop("y").alias("sy"), F.stddev_pop("p").alias("sp"))
    return s.select(*keys, F.when((F.col("n") >= 2) & (F.col("sy") > 0) & (F.col("sp") > 0), F.col("c") / (F.col("sy") * F.col("sp"))).alias("rho"), "n")


def simplex(panel: DataFrame, column: str, dims: Sequence[int], tau: int = 1, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Self-prediction one step ahead, by dimension."""
    w = over(keys, "t")
    parts = []
    for dim in dims:
        rows = delay_embedding(panel.withColumn("y", F.lead(column).over(w)), column, dim, tau, 0, keys).filter("y is not null").select(*keys, F.lit(dim).alias("E"), "t", "y", "emb")
        parts.append(skill(nearest(rows, [*keys, "E"], dim + 1, max(tau, 1)), [*keys, "E"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_dimension(curve: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """The dimension with the largest rho, the smallest of equals."""
    best = curve.filter("rho is not null").groupBy(*keys).agg(F.min(F.struct((-F.col("rho")).alias("r"), "E")).alias("b"))
    return best.select(*keys, F.col("b.E").alias("E"), (-F.col("b.r")).alias("rho"))


def cross_map(panel: DataFrame, cause: str, effect: str, dim: int, tau: int, lags: Sequence[int], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Skill at every lag of predicting the cause from the effect's states, leaving the row itself out."""
    rows = lag_family(panel, cause, effect, dim, tau, lags, keys)
    return skill(nearest(rows, [*keys, "lag"], dim + 1), [*keys, "lag"])


def best_lag(skills: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """The lag with the largest rho, the smallest (most negative) of equals."""
    best = skills.filter("rho is not null").groupBy(*keys).agg(F.min(F.struct((-F.col("rho")).alias("r"), "lag", "n")).alias("b"))
    return best.select(*keys, F.col("b.lag").alias("obs_lag"), (-F.col("b.r")).alias("obs_rho"), F.col("b.n").alias("obs_n"))


def prefix_convergence(panel: DataFrame, cause: str, effect: str, dim: int, tau: int, sizes: Sequence[int], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Skill with libraries of the first L rows, for each L."""
    rows = lag_family(panel, cause, effect, dim, tau, [0], keys).withColumn("at", F.row_number().over(over(keys, "t")))
    each = rows.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    library = each.filter("at <= size").alias("b")
    a = each.alias("a")
    cond = (F.col("a.size") == F.col("b.size")) & (F.col("a.t") != F.col("b.t"))
    for c in keys:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = a.join(library, cond).select(*[F.col(f"a.{c}").alias(c) for c in keys], F.col("a.size").alias("size"), F.col("a.t").alias("t"), F.col("a.y").alias("y"), F.col("b.t").alias("lib_t"), F.col("b.y").alias("lib_y"), distance(F.col("a.emb"), F.col("b.emb")).alias("d"))
    rank = F.row_number().over(Window.partitionBy(*keys, "size", "t").orderBy("d", "lib_t"))
    return skill(pairs.withColumn("rank", rank).filter(F.col("rank") <= dim + 1), [*keys, "size"])
