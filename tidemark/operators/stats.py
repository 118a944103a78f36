"""Rank and paired tests, false-discovery control and evidence classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import lag_class, normal_cdf
from tidemark.operators.ranks import family_key, ranged, running, tie_ranks
from tidemark.plans.lineage import cut


def benjamini_hochberg(df: DataFrame, p: str, family: Sequence[str] = (), out: str = "p_fdr") -> DataFrame:
    """Step-up adjusted p within a family; null p-values are no members and stay null.

    Equal p-values share the largest of their ranks and so one adjusted value:
    distinct values are ranked, and rows take their value's figure.  The rows are
    stored first: p-values computed twice may differ in their last bit, and then
    would not meet their figure.
    """
    keyed = cut(df.withColumn("_family", family_key(family)))
    counts = keyed.filter(F.col(p).isNotNull()).groupBy("_family", p).agg(F.count("*").alias("_n"))
    spread = ranged(counts, p)
    ranked = running(spread, p, F.col("_n"), "_rank")
    ranked = ranked.join(spread.groupBy("_family").agg(F.sum("_n").alias("_k")), "_family")
    raw = F.col(p) * F.col("_k") / F.col("_rank")
    adjusted = running(cut(ranked), p, raw, "_low", lowest=True).select("_family", p, F.least(F.lit(1.0), "_low").alias(out))
    return keyed.join(adjusted, ["_family", p], "left").select(*df.columns, out)


def classify_edges(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusted p over the OK edges, significance with convergence, lag class and causal evidence."""
    valid = (F.col("status") == "OK") & F.col("p_value").isNotNull()
    kept = edges.withColumn("_p", F.when(valid, F.col("p_value")))
    tested = benjamini_hochberg(kept, "_p").drop("_p")
    significant = F.coalesce((F.col("p_fdr") < alpha) & F.coalesce("converges", F.lit(False)) & F.col("obs_lag").isNotNull(), F.lit(False))
    tested = tested.withColumn("significant", significant)
    return tested.withColumns({"lag_resolution": lag_class(F.col("significant"), F.col("obs_lag")), "causal_evidence": F.coalesce(F.col("significant") & (F.col("obs_lag") >= 0), F.lit(False))})


def surrogate_p(df: DataFrame, keys: Sequence[str], null: str, observed: str) -> DataFrame:
    """p with one added to both counts, mean, population sd and number of the null values."""
    n = F.count(null)
    return df.groupBy(*keys).agg(
        F.max(observed).alias("observed"),
        ((F.count_if(F.col(null) >= F.col(observed)) + 1) / (n + 1)).alias("p_value"),
        F.avg(null).alias("null_mean"),
        F.stddev_pop(null).alias("null_std"),
        n.alias("n_valid"),
    )


def kendall_tau(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """tau-b by comparing all pairs of a group; groups are short curves."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(x, y)))
    a, b = numbered.alias("a"), numbered.alias("b")
    cond = F.col("a._i") < F.col("b._i")
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    sx, sy = F.signum(F.col(f"b.{x}") - F.col(f"a.{x}")), F.signum(F.col(f"b.{y}") - F.col(f"a.{y}"))
    pairs = a.join(b, cond).select(*[F.col(f"a.{k}").alias(k) for k in keys], sx.alias("sx"), sy.alias("sy"))
    s = pairs.groupBy(*keys).agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"))
    return s.select(*keys, F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def mann_whitney(df: DataFrame, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """U of the rows where ``group`` is true, AUC, and the two-sided normal p with ties and continuity."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumn("_family", family_key(keys))
    counts = rows.groupBy("_family", *keys, value).agg(F.count("*").alias("t"), F.count_if(F.col(group)).alias("a"))
    ranked = tie_ranks(counts, value, "t")
    s = ranked.groupBy(*keys).agg(
        F.sum("a").alias("n1"), F.sum(F.col("t") - F.col("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties")
    ).filter("n1 > 0 and n2 > 0")
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    big = F.greatest(u, F.col("n1") * F.col("n2") - u)
    z = F.when(var > 0, (big - F.col("n1") * F.col("n2") / 2 - 0.5) / F.sqrt(var))
    t = s.select(*keys, "n1", "n2", u.alias("u"), (u / (F.col("n1") * F.col("n2"))).alias("auc"), z.alias("_z"))
    return t.withColumn("p_value", F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.col("_z"))))).drop("_z")


def diebold_mariano(aligned: DataFrame, keys: Sequence[str], horizon: str = "h", origin: str = "t0", loss: str = "squared", least: int = 10) -> DataFrame:
    """Statistic and two-sided p of equal accuracy of ``p1`` and ``p2`` for ``actual``.

    The loss difference's variance is Newey-West with Bartlett weights up to
    ``h - 1``; each lag's covariance centres both sub-series on their own means.
    """
    e1, e2 = F.col("actual") - F.col("p1"), F.col("actual") - F.col("p2")
    d = e1 * e1 - e2 * e2 if loss == "squared" else F.abs(e1) - F.abs(e2)
    rows = aligned.filter("actual is not null and p1 is not null and p2 is not null").withColumn("d", d)
    group = [*keys, horizon]
    rows = rows.select(*group, "d", F.row_number().over(Window.partitionBy(*group).orderBy(origin)).alias("i"))
    base = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("var"))
    ahead = rows.filter(F.col(horizon) > 1).withColumn("l", F.explode(F.sequence(F.lit(1), F.col(horizon) - 1)))
    later = rows.select(*group, F.col("i").alias("j"), F.col("d").alias("d2"))
    pairs = ahead.withColumn("j", F.col("i") + F.col("l")).join(later, [*group, "j"])
    lagged = pairs.groupBy(*group, "l").agg(F.covar_pop("d", "d2").alias("c"), F.count("*").alias("k")).filter("k >= 2")
    extra = lagged.groupBy(*group).agg(F.sum(2 * (1 - F.col("l") / F.col(horizon)) * F.col("c")).alias("extra"))
    all_ = base.join(extra, group, "left")
    var = F.greatest(F.col("var") + F.coalesce("extra", F.lit(0.0)), F.lit(1e-12))
    stat = F.when(F.col("n") >= least, F.col("mean") / F.sqrt(var / F.col("n")))
    # A column of its own: the series of the distribution function refers to it many times.
    return all_.select(*group, stat.alias("dm_stat"), "n").withColumn("p_value", 2 * (1 - normal_cdf(F.abs("dm_stat"))))


def error_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """RMSE, MAE, NSE, PBIAS and the number of complete pairs, null where undefined."""
    both = F.col(actual).isNotNull() & F.col(pred).isNotNull()
    a, p = F.when(both, F.col(actual)), F.when(both, F.col(pred))
    s = df.groupBy(*keys).agg(
        F.count(a).alias("n_eval"), F.avg((a - p) * (a - p)).alias("mse"), F.avg(F.abs(a - p)).alias("mae"), F.var_pop(a).alias("var"),
        F.sum(a).alias("sum"), F.sum(F.abs(a)).alias("size"), F.sum(a - p).alias("bias"),
    )
    steady = F.abs("sum") < 1e-6 * F.greatest(F.lit(1.0), F.col("size"))
    return s.select(*keys, F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).alias("nse"), F.when(~steady, 100 * F.col("bias") / F.col("sum")).alias("pbias"), "n_eval")
