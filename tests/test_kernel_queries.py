"""Kernel queries run with the analysis' own parameters."""

from __future__ import annotations

import pytest

from tidemark.config import DRIVER
from tidemark.operators import models
from tidemark.queries.kernels import QUERIES


@pytest.mark.parametrize(
    ("query", "operator", "want"),
    [
        ("full_edge_test", "test_edges", (3, 1, DRIVER.lags, DRIVER.n_surrogates)),
        ("iaaft_surrogate", "surrogates", ("P", DRIVER.n_surrogates)),
        ("gbdt_tuning", "tune", ("WL", DRIVER.tuning_grid)),
    ],
)
def test_query_asks_for_the_whole_analysis(spark, monkeypatch, query, operator, want):
    asked = []
    monkeypatch.setattr(models, operator, lambda frame, *args, **more: asked.append((args, more)) or frame)
    QUERIES[query].run(spark, "/root/testdata/sf0.001")
    assert asked == [(want, {})]
    assert (DRIVER.lags, DRIVER.n_surrogates, len(DRIVER.tuning_grid)) == (tuple(range(-12, 13)), 500, 6)
