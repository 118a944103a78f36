"""Parameters of the panel engine; every constant of an analysis lives here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    horizon: int = 37
    rolling_horizons: tuple[int, ...] = (1, 3, 6, 12)
    tau: int = 1
    embed_dims: tuple[int, ...] = tuple(range(2, 11))
    alpha: float = 0.05
    lags: tuple[int, ...] = tuple(range(-12, 13))
    forecast_lags: tuple[int, ...] = tuple(range(1, 13))
    ar_lags: tuple[int, ...] = (1, 2, 3, 6, 12)
    antecedent_windows: tuple[int, ...] = (3, 6)
    max_gap: int = 6
    z_change: float = 6.0
    z_level: float = 5.0
    min_diffs: int = 10
    min_months: int = 60
    min_embed_obs: int = 30
    n_surrogates: int = 500
    tuning_grid: tuple[tuple[int, float, int], ...] = ((2, 0.05, 200), (2, 0.05, 400), (3, 0.05, 200), (3, 0.05, 400), (2, 0.1, 200), (3, 0.1, 200))


DEFAULT = Config()
#: The driver's tables span 80 months, so their queries hold back a year.
DRIVER = Config(horizon=12, embed_dims=(2, 3, 4), z_change=3.0, z_level=2.0)
