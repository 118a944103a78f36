"""Micro-fixtures: one or more semantic traps each."""

from __future__ import annotations

import collections
import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import embedding, evaluate, features, geo, graph, kernels, models, panel, quality, ranks, report, selection, series, stats
from tidemark.plans import runs
from tidemark.sources import readers


def month(i: int) -> dt.date:
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def frame(spark, values, extra=(), name="x"):
    rows = [(*extra, month(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ", ".join([*(f"k{j} string" for j in range(len(extra))), "month date", f"{name} double"]))


def monthly(spark, values, name="x", entity="a"):
    return frame(spark, values, (entity,), name).withColumnRenamed("k0", "entity")


def column(df, name, order="month"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_outlier_flags_the_month_and_the_observed_one_before(spark):
    rng = random.Random(1)
    values = [10 + rng.random() for _ in range(24)]
    values[12], values[11], values[13] = 50.0, None, 51.0
    df = frame(spark, values, ("a", "s"), "value").toDF("entity", "station", "month", "value")
    got = sorted(r.month for r in quality.outliers(df).collect())
    assert got == [month(12), month(13)]  # 12 by its jump, 13 as the month before the jump back; 11 wasn't observed
    cleaned = quality.blank(df, quality.outliers(df))
    assert cleaned.count() == 24 and cleaned.filter("value is null").count() == 3
    assert quality.outliers(df.filter("month < '2000-09-01'")).isEmpty()


def test_combination_weighs_gauges_not_observations(spark):
    rows = [("e", "A", month(0), 9.0), ("e", "A", month(1), 11.0), ("e", "A", month(2), None), ("e", "B", month(0), 19.0), ("e", "B", month(1), 20.0), ("e", "B", month(2), 21.0)]
    got = panel.combine_stations(spark.createDataFrame(rows, "entity string, station string, month date, value double"))
    assert column(got, "wl") == pytest.approx([14.0, 15.5, 16.0])


def test_gap_operators(spark):
    values = [None, None, 1.0, None, 2.0, *[None] * 6, 9.0, *[None] * 7, 3.0, None, None, None]
    df = monthly(spark, values)
    filled = column(series.fill_gaps(df, "x", 6), "x")
    assert filled[:3] == [1.0, 1.0, 1.0] and filled[3] == 1.5 and filled[5:11] == pytest.approx([3, 4, 5, 6, 7, 8])
    assert filled[12:19] == [None] * 7 and filled[-3:] == [3.0] * 3
    forward = column(df.withColumn("x", series.forward_fill("x", 6, series.over(("entity",), "month"))), "x")
    assert forward[:2] == [None, None] and forward[12:18] == [9.0] * 6 and forward[18] is None
    assert series.longest_gap(df, "x").first().longest_gap == 7
    spans = [(r.start, r.end, r.length) for r in series.gap_spans(df, "x").orderBy("start").collect()]
    assert spans == [(month(0), month(2), 2), (month(5), month(11), 6), (month(12), month(19), 7), (month(20), month(22), 3)]


def test_season_uses_training_rows_only(spark):
    values = [float(i % 12) for i in range(36)]
    values[2] = values[14] = None  # March is never seen in training
    values[30] = 100.0
    p = series.with_position(monthly(spark, values))
    got = column(panel.deseasonalise(p, ["x"], 12), "x")
    assert got[2] is None and got[26] is None and got[30] == 94.0 and got[0] == 0.0


def test_rolling_needs_full_windows(spark):
    df = monthly(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, 8.0])
    w = series.over(("entity",), "month")
    assert column(df.withColumn("m", series.rolling(F.avg, "x", 3, w)), "m") == [None, None, 2.0, None, None, None, 6.0, 7.0]
    p = series.with_position(df)
    x = features.exogenous_features(p, {"x": 2}, (3,))
    assert column(x, "x_lag")[2:5] == [1.0, 2.0, 3.0] and column(x, "x_mean3") == [None, None, None, None, 2.0, None, None, None]
    s = features.state_features(p, "x", (1, 2, 3, 6, 12))
    assert column(s, "wl_diff3")[6] == 6.0 - 3.0 and column(s, "wl_mean3")[7] == 6.0 and column(s, "wl_std3")[7] == pytest.approx(1.0)
    assert column(series.difference_of_observed(df, "x", ("entity",)), "change") == [None, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0]


def test_ties(spark):
    curve = spark.createDataFrame([("a", 5, 0.5), ("a", 3, 0.5), ("a", 2, 0.4), ("b", 2, None)], "entity string, E int, rho double")
    assert [(r.entity, r.E) for r in embedding.select_dimension(curve).collect()] == [("a", 3)]
    lags = spark.createDataFrame([("a", 4, 0.5, 9), ("a", -2, 0.5, 9)], "entity string, lag int, rho double, n int")
    assert embedding.best_lag(lags).first().obs_lag == -2


def test_constant_predictors_have_no_correlation(spark):
    rng = random.Random(0)
    rows = [("a", t, rng.random(), 1.0, rng.random()) for t in range(1, 41)]
    p = spark.createDataFrame(rows, "entity string, t int, y double, flat double, live double")
    got = features.cross_correlations(p, "y", ["flat", "live"], [1, 2]).collect()
    assert {r.variable for r in got} == {"live"} and all(abs(r.r) <= 1 for r in got)


def test_regulated_sum(spark):
    rows = [("e", "A", month(0), 1.0), ("e", "B", month(0), 2.0), ("e", "A", month(1), 3.0), ("e", "B", month(1), None), ("e", "C", month(0), None)]
    df = spark.createDataFrame(rows, "entity string, station string, month date, value double")
    assert column(panel.regulated_sum(df), "flow") == [3.0, None]
    assert column(panel.regulated_sum(df, years=(2001, 2002)), "flow") == [None, None]


def test_edge_classes(spark):
    rows = [("a", "b", "OK", 3, 0.5, 99, 0.001, True), ("a", "c", "OK", 0, 0.5, 99, 0.002, True), ("a", "d", "OK", -1, 0.5, 99, 0.003, True), ("a", "e", "OK", 2, 0.5, 99, 0.004, None), ("a", "f", "insufficient_data", 2, 0.5, 9, 0.0001, True), ("a", "g", "OK", 2, 0.5, 99, None, True), ("a", "h", "OK", 1, 0.1, 99, 0.9, True)]
    e = spark.createDataFrame(rows, "cause string, effect string, status string, obs_lag int, obs_rho double, obs_n int, p_value double, converges boolean")
    got = {r.effect: r for r in stats.classify_edges(e).collect()}
    assert [got[k].lag_resolution for k in "bcdefgh"] == ["resolved", "unresolved_contemporaneous", "rejected_reverse", *["not_significant"] * 4]
    assert [got[k].causal_evidence for k in "bcdefgh"] == [True, True, False, False, False, False, False]
    assert got["d"].significant and got["f"].p_fdr is None and got["g"].p_fdr is None
    assert got["b"].p_fdr == pytest.approx(0.005)  # five tests in the family
    kept = selection.retained(stats.classify_edges(e))
    assert sorted(r.effect for r in kept.collect()) == ["b", "c"]


def test_fdr_is_monotone_and_capped(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9, 0.9, 1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = {r.i: r.p_fdr for r in stats.benjamini_hochberg(df, "p").collect()}
    order = sorted(range(7), key=lambda i: p[i])
    raw = [p[i] * 7 / (k + 1) for k, i in enumerate(order)]
    assert [got[i] for i in order] == pytest.approx([min(1.0, *raw[k:], 1.0) for k in range(7)])


def test_ranks_over_many_ranges(spark):
    """Ties, families and nulls, dealt over more ranges than one; held against a plain loop."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.5, 0.5, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, k string, p double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = ranks.ranged(df.filter("p is not null").select(F.lit("").alias("_family"), "p").distinct(), "p")
        assert spread.select("_range").distinct().count() > 1
        low = {r.i: r.p_fdr for r in stats.benjamini_hochberg(df, "p", ["k"]).collect()}
        rank = {r.i: r["rank"] for r in ranks.average_rank(df, "p", ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(low) == len(rank) == 3000
    for k in ("a", "b", None):
        members = sorted((p, i) for i, f, p in rows if f == k and p is not None)
        values, best = [p for p, _ in members], 1.0
        for place in range(len(members), 0, -1):
            p, i = members[place - 1]
            best = min(best, p * len(members) / place)
            assert low[i] == pytest.approx(best)
            below, same = sum(v < p for v in values), values.count(p)
            assert rank[i] == below + (same + 1) / 2
    assert all(low[i] is None and rank[i] is None for i, _, p in rows if p is None)


def test_graph_loops_against_plain_search(spark):
    rng = random.Random(5)
    edges = [(k, rng.randrange(60), rng.randrange(60)) for k in "xy" for _ in range(40)] + [("x", i, i + 1) for i in range(100, 130)]
    df = spark.createDataFrame(edges, "entity string, src int, dst int")
    got = {(r.entity, r.node): r.component for r in graph.components(df).collect()}
    label = {(k, n): n for k, a, b in edges for n in (a, b)}
    for _ in range(200):
        for k, a, b in edges:
            label[k, a] = label[k, b] = min(label[k, a], label[k, b])
    assert got == label
    above = {(r.entity, r.node) for r in graph.ancestors(df, spark.createDataFrame([("x", 130), ("y", 7)], "entity string, target int")).collect()}
    want = set()
    for k, t in (("x", 130), ("y", 7)):
        todo, seen = [t], {t}
        while todo:
            n = todo.pop()
            fresh = {a for e, a, b in edges if e == k and b == n} - seen
            seen |= fresh
            todo += fresh
        want |= {(k, n) for n in seen - {t}}
    assert above == want


def logistic(n=300):
    x, y = np.empty(n), np.empty(n)
    x[0], y[0] = 0.4, 0.2
    for i in range(n - 1):
        x[i + 1] = x[i] * (3.8 - 3.8 * x[i])
        y[i + 1] = y[i] * (3.5 - 3.5 * y[i] - 0.1 * x[i])
    return x, y


def test_cross_map_direction_and_both_paths_agree(spark):
    x, y = logistic(200)
    p = spark.createDataFrame([("a", i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "entity string, t int, x double, y double")
    forth = {r.lag: r.rho for r in embedding.cross_map(p, "x", "y", 2, 1, [0, 1]).collect()}
    back = embedding.cross_map(p, "y", "x", 2, 1, [0]).first().rho
    assert forth[0] > back
    for lag in (0, 1):
        emb = kernels.states(y, 2, 1, lag)
        rows = np.flatnonzero(~np.isnan(emb).any(axis=1))
        assert forth[lag] == pytest.approx(kernels.cross_map_rho(emb[rows], x[rows], 3)[0], abs=1e-9)


def test_simplex_finds_the_map_predictable(spark):
    x, _ = logistic(120)
    p = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "entity string, t int, x double")
    curve = embedding.simplex(p, "x", [2, 3])
    assert min(r.rho for r in curve.collect()) > 0.9
    assert embedding.select_dimension(curve).first().E in (2, 3)


def test_edge_test_on_coupled_maps(spark):
    x, y = logistic(220)
    rows = [("a", "x", "y", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "entity string, cause string, effect string, t int, x double, y double")
    r = models.test_edges(df, 2, 1, (-1, 0, 1), 19, draws=10).first()
    assert r.status == "OK" and r.p_value == pytest.approx(1 / 20) and r.n_valid == 19
    short = models.test_edges(df.filter("t < 25"), 2, 1, (0,), 9).first()
    assert short.status == "insufficient_cause_observations" and short.obs_lag is None


def test_surrogates_keep_the_values(spark):
    x, _ = logistic(100)
    s = kernels.iaaft(x, np.random.default_rng(0))
    assert np.allclose(np.sort(s), np.sort(x)) and not np.allclose(s, x)
    a, b = np.abs(np.fft.rfft(x))[1:], np.abs(np.fft.rfft(s))[1:]
    assert np.corrcoef(a, b)[0, 1] > 0.9
    assert kernels.seed("P", "WL") == int(__import__("hashlib").md5(b"P|WL").hexdigest()[:8], 16)


def test_exact_tests():
    assert kernels.kendall(np.arange(9), np.arange(9))[1] == pytest.approx(2 / math.factorial(9))
    assert kernels.kendall(np.arange(4), np.array([1, 2, 4, 3]))[0] == pytest.approx(4 / 6)
    x, y = np.array([1.0, 1, 2, 2, 3, 4, 5, 5]), np.array([2.0, 1, 2, 3, 3, 3, 5, 6])
    sign = [np.sign(x[j] - x[i]) * np.sign(y[j] - y[i]) for i in range(8) for j in range(i + 1, 8)]
    ties = [np.unique(v, return_counts=True)[1] for v in (x, y)]
    var = (8 * 7 * 21 - sum((t * (t - 1) * (2 * t + 5)).sum() for t in ties)) / 18 + np.prod([(t * (t - 1)).sum() for t in ties]) / (2 * 8 * 7) + np.prod([(t * (t - 1) * (t - 2)).sum() for t in ties]) / (9 * 8 * 7 * 6)
    assert kernels.kendall(x, y)[1] == pytest.approx(math.erfc(abs(sum(sign)) / math.sqrt(2 * var)))
    assert kernels.mann_whitney_exact(201, 7, 38) == pytest.approx(0.0323536, abs=1e-6)
    assert kernels.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)


def test_mann_whitney_with_ties(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (None, True)], "x double, g boolean")
    r = stats.mann_whitney(df, "x", "g").first()
    assert (r.n1, r.n2, r.u, r.auc) == (2, 2, 0.5, 0.125) and 0 < r.p_value <= 1


def test_diebold_mariano(spark):
    rng = np.random.default_rng(1)
    a, p1, p2 = (rng.normal(size=12) for _ in range(3))
    rows = [("e", 3, i, *map(float, v)) for i, v in enumerate(zip(a, p1, p2, strict=True))]
    df = spark.createDataFrame(rows, "entity string, h int, t0 int, actual double, p1 double, p2 double")
    d = (a - p1) ** 2 - (a - p2) ** 2
    var = d.var() + sum(2 * (1 - k / 3) * np.mean((d[:-k] - d[:-k].mean()) * (d[k:] - d[k:].mean())) for k in (1, 2))
    stat = d.mean() / math.sqrt(max(var, 1e-12) / 12)
    r = stats.diebold_mariano(df, ["entity"]).first()
    assert r.dm_stat == pytest.approx(stat) and r.p_value == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), abs=1e-9)
    assert stats.diebold_mariano(df.filter("t0 < 9"), ["entity"]).first().dm_stat is None


def test_metrics_guards(spark):
    df = spark.createDataFrame([("zero", 1.0, 0.0), ("zero", -1.0, 0.0), ("flat", 2.0, 1.0), ("flat", 2.0, 3.0), ("none", None, 1.0)], "k string, actual double, pred double")
    got = {r.k: r for r in stats.error_metrics(df, ["k"]).collect()}
    assert got["zero"].pbias is None and got["zero"].nse == 0.0 and got["flat"].nse is None and got["flat"].pbias == 0.0
    assert got["none"].n_eval == 0 and got["none"].rmse is None


def test_persistence(spark):
    p = series.with_position(monthly(spark, [float(i) for i in range(12)] + [None, 5.0, 6.0]))
    single = evaluate.persistence(p, "x", 2)
    assert stats.error_metrics(single, ["entity"]).first().n_eval == 0  # the last training value is null
    rolling = evaluate.rolling_persistence(p, "x", [1], 4)
    assert [(r.t0, r.actual, r.pred) for r in rolling.orderBy("t0").collect()] == [(11, 11.0, 10.0), (12, None, 11.0), (14, 6.0, 5.0)]


def test_closure_with_cycles(spark):
    e = spark.createDataFrame([("x", "A", "B", 1), ("x", "B", "A", 1), ("x", "B", "WL", 2), ("x", "C", "A", 1), ("x", "WL", "D", 1)], "entity string, src string, dst string, lag int")
    assert sorted(r.node for r in graph.ancestors(e, "WL").collect()) == ["A", "B", "C"]
    assert sorted(r.node for r in graph.ancestors(e.orderBy(F.desc("src")), "WL").collect()) == ["A", "B", "C"]
    pairs = spark.createDataFrame([("w", a, b) for a, b in ((1, 2), (2, 3), (4, 5), (6, 7), (7, 8), (8, 9), (9, 10))], "entity string, src int, dst int")
    assert sorted({r.component for r in graph.components(pairs).collect()}) == [1, 4, 6]


def test_relational_division(spark):
    rows = [(e, m, h, 1.0) for e in "abc" for m in ("p", "q") for h in (1, 3) if (e, m, h) != ("b", "q", 3)]
    kept = evaluate.matched(spark.createDataFrame(rows, "entity string, method string, h int, rmse double"), "entity", ["method", "h"])
    assert sorted({r.entity for r in kept.collect()}) == ["a", "c"]


def test_geometry(spark):
    square = spark.createDataFrame([("s", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)])], "polygon string, ring array<struct<lon:double,lat:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 1.0), (3, 4.5, 4.5), (4, 9.0, 9.0)], "point int, lon double, lat double")
    assert [r.point for r in geo.containing(pts, square).collect()] == [1]
    got = {r.point: (r.polygon, r.contains) for r in geo.resolve(pts, square).collect()}
    assert got == {1: ("s", True), 2: ("s", False), 3: ("s", False), 4: (None, False)}  # 2 is 1.0 from an edge, though not from a corner
    assert geo.grid_cells(square).count() == 16


def test_cells_meet_polygons(spark):
    """A thin triangle meets cells whose centre it misses; a polygon within one cell has that cell."""
    rows = [("thin", [(0.1, 0.1), (2.9, 0.2), (0.1, 0.2), (0.1, 0.1)]), ("tiny", [(5.2, 5.2), (5.3, 5.2), (5.25, 5.3), (5.2, 5.2)]), ("wide", [(-9.0, -9.0), (-5.0, -9.0), (-5.0, -5.0), (-9.0, -5.0), (-9.0, -9.0)])]
    cells = geo.grid_cells(spark.createDataFrame(rows, "polygon string, ring array<struct<lon:double,lat:double>>"))
    got = collections.Counter(r.polygon for r in cells.collect())
    assert got == {"thin": 3, "tiny": 1, "wide": 16}


def test_basin_cells(spark):
    def square(x):
        return [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]

    basins = spark.createDataFrame([(1, 0, square(0.0)), (2, 1, square(10.0)), (3, 2, square(20.0)), (4, 0, square(30.0))], "node int, down int, ring array<struct<lon:double,lat:double>>")
    outlet = spark.createDataFrame([(0.5, 0.5)], "lon double, lat double")
    assert {r.lon for r in geo.basin_cells(basins, outlet, step=1.0).collect()} >= {0.5, 10.5, 20.5}
    assert not {r.lon for r in geo.basin_cells(basins, outlet, step=1.0).collect()} & {30.5}


def test_scalars(spark):
    df = spark.createDataFrame([(" Yes ", "1.5"), ("0", "x"), (None, "NaN")], "a string, b string")
    assert [tuple(r) for r in df.select(scalar.as_bool("a"), scalar.to_number("b")).collect()] == [(True, 1.5), (False, None), (False, None)]
    z = spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 1.96, 5.0)], "z double").select(scalar.normal_cdf(F.col("z"))).collect()
    assert [r[0] for r in z] == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in (-3.0, -0.5, 0.0, 1.96, 5.0)], abs=1e-12)
    cells = spark.createDataFrame([("ERROR: x", None, 1), (None, "(1, 0, 0)(0, 0, 1, 12)", None), (None, None, 0), (None, None, 3)], "s string, o string, n int")
    assert [r[0] for r in cells.select(scalar.model_cell(F.col("s"), F.col("o"), F.col("n"))).collect()] == ["failed", "(1,0,0)(0,0,1,12)", "no exogenous", "3"]
    with pytest.raises(ValueError):
        scalar.to_unit(F.lit(1.0), "furlong")


def test_kernels_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.5 * x[:, 1] + 0.05 * rng.normal(size=300)
    model = kernels.BoostedTrees(2, 0.1, 150).fit(x[:200], y[:200])
    assert np.mean((model.predict(x[200:]) - y[200:]) ** 2) < 0.3 * y[200:].var()
    assert kernels.stepwise(y, x, ["a", "b", "c", "d"])[:2] == ["a", "b"]
    t = np.arange(180)
    season = 3 * np.sin(2 * np.pi * t / 12) + 0.1 * rng.normal(size=180)
    fit = kernels.SeasonalArima.choose(season[:168])
    assert np.sqrt(np.mean((fit.forecast(12) - season[168:]) ** 2)) < 1.0
    walk = np.cumsum(rng.normal(size=100))
    assert abs(kernels.SeasonalArima(1, 1, 0).fit(walk).forecast(1)[0] - walk[-1]) < 3


def test_method_registry(spark):
    sets = spark.createDataFrame([("a", "direct", 2), ("a", "neighbor", 1), ("a", "ancestors", 0), ("b", "neighbor", 1), ("b", "ancestors", 3)], "entity string, lag_set string, n int")
    got = {}
    for r in models.runnable_methods(sets).collect():
        got.setdefault(r.entity, set()).add(r.method)
    assert "SARIMAX_CCM_neighbor" not in got["a"] and "SARIMAX_CCM_neighbor" in got["b"]
    assert {"Persistence", "SARIMA", "XGBoost_AR_only", "SARIMAX_CCM_direct"} <= got["a"]


def test_readers(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Year/Année, Month/Mois,Value/Valeur\n1994,1,3.5\n1994,2,\n1994,3,NaN\n", encoding="utf-8")
    assert [(str(r.month), r.water_level) for r in readers.read_gauge_csv(spark, str(tmp_path / "g.csv"), "s").orderBy("month").collect()] == [("1994-01-01", 3.5), ("1994-02-01", None), ("1994-03-01", None)]
    (tmp_path / "p.json").write_text('{"L1": {"WL": {"E": 4, "tau": 1, "n_obs": 300}}, "L2": {"P": {"E": null, "tau": 1, "n_obs": 3, "status": "too_short"}}}')
    assert sorted((r.entity, r.variable, r.E) for r in readers.read_embedding_params(spark, str(tmp_path / "p.json")).collect()) == [("L1", "WL", 4), ("L2", "P", None)]
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.require_columns(spark.range(1), ["id", "z"])


def test_resumable_runs(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "b"), ("b", "a")], "cause string, effect string")
    path, config = str(tmp_path / "out"), {"lags": [1]}
    assert runs.remaining(tasks, path, ["cause", "effect"], config).count() == 2
    runs.append(tasks.limit(1), path, config)
    assert tuple(runs.status(tasks, path, ["cause", "effect"], config).first()) == (2, 1, 1)
    assert runs.remaining(tasks, path, ["cause", "effect"], {"lags": [2]}).count() == 2
    assert {r.problem for r in runs.coverage(spark.read.parquet(path), tasks, ["cause", "effect"]).collect()} == {"missing"}


def test_report_text(spark):
    df = spark.createDataFrame([("a|b", 1.23456, 0.00001, True, None)], "k string, x double, p double, ok boolean, z int")
    text = report.to_markdown(df)
    assert r"| a\|b | 1.235 | 1.00e-05 | yes |  |" in text and "| --- | ---: | ---: | --- | ---: |" in text
    assert "| 1.2 | 1.00e-05 |" in report.to_markdown(df, {"x": 1})
    assert report.report({"T": df}, {"T": "note"}).startswith("## T\n\n|")


def test_whole_stepwise_selection(spark):
    """Against least squares by hand: the drivers that make the level, in the order of what they add."""
    rng = np.random.default_rng(5)
    rows = []
    for entity in ("a", "b"):
        p, q, r = rng.standard_normal((3, 90))
        level = np.full(90, np.nan)
        level[2:] = 2.0 * p[1:-1] + (1.0 * q[:-2] if entity == "a" else 0.0) + 0.1 * rng.standard_normal(88)
        rows += [(entity, t, None if np.isnan(level[t]) else float(level[t]), float(p[t]), float(q[t]), float(r[t])) for t in range(90)]
    panel = spark.createDataFrame(rows, "entity string, t int, WL double, P double, Q double, R double")
    lags = spark.createDataFrame([(e, v, k) for e in "ab" for v, k in (("P", 1), ("Q", 2))], "entity string, variable string, lag int")
    got = {(r.entity, r.step): (r.variable, r.lag) for r in selection.stepwise_lags(panel, lags, "WL", criterion="bic").collect()}
    assert got == {("a", 1): ("P", 1), ("a", 2): ("Q", 2), ("b", 1): ("P", 1)}


def test_models_keep_the_calendar():
    """A short inner gap is filled on a line, a long one is an error, and leading months go."""
    values = pd.Series([np.nan, 1.0, 2.0, np.nan, np.nan, 5.0])
    assert models._regular(values).tolist() == [1.0, 2.0, 3.0, 4.0, 5.0]
    with pytest.raises(ValueError, match="gap of more than 6"):
        models._regular(pd.Series([1.0, *[np.nan] * 7, 2.0]))


def test_predeclared_comparisons(spark):
    rows = [(m, "e", 1, t, float(t), p) for t in range(12) for m, p in (("m1", t + 1.0), ("m2", t + 2.0 if t != 3 else None))]
    pairs = spark.createDataFrame([("m1", "m2"), ("m1", "m3")], "method_1 string, method_2 string")
    both = evaluate.compare(spark.createDataFrame(rows, "method string, entity string, h int, t0 int, actual double, pred double"), pairs).collect()
    assert len(both) == 11 and {(r.method_1, r.method_2) for r in both} == {("m1", "m2")} and all(r.p2 - r.p1 == 1 for r in both)
