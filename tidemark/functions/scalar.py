"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bool(c) -> Column:
    """True for true, 1 and yes, whatever the case and the spaces around; false else, null included."""
    return F.coalesce(F.lower(F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def to_number(c: str) -> Column:
    """Double, or null for what isn't a number (NaN too)."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_unit(value, unit: str, month=None) -> Column:
    """Convert from a source unit: K to degrees C, m to mm, m/day to mm/month, evaporation as a positive loss."""
    days = F.dayofmonth(F.last_day(month)) if month is not None else None
    if unit == "K":
        return value - 273.15
    if unit == "m":
        return value * 1000.0
    if unit == "m/day":
        return value * 1000.0 * days
    if unit == "-m/day":
        return -(value * 1000.0 * days)
    raise ValueError(f"unknown unit: {unit}")


def pair_key(a, b, separator: str = "|") -> Column:
    """The same for (a, b) and (b, a)."""
    return F.concat_ws(separator, F.array_sort(F.array(a, b)))


def seed_of(*parts) -> Column:
    """A 32-bit seed: the first eight hex digits of the md5 of the parts joined by ``|``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def fingerprint(c) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def sorted_json(keys, values) -> Column:
    """A JSON object with sorted keys from two aligned arrays."""
    return F.to_json(F.map_from_entries(F.array_sort(F.arrays_zip(keys, values))))


def lag_class(significant, lag) -> Column:
    return (
        F.when(~significant, "not_significant").when(lag > 0, "resolved").when(lag == 0, "unresolved_contemporaneous").otherwise("rejected_reverse")
    )


def normal_cdf(z: Column, terms: int = 60) -> Column:
    """Standard normal distribution function by its power series; beyond 6 it is 0 or 1 to double precision's purpose."""
    a = F.least(F.abs(z), F.lit(6.0))
    start = F.struct(a.alias("term"), a.alias("total"))

    def add(state, n):
        term = state["term"] * a * a / (2 * n + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda s: s["total"])
    upper = F.least(F.lit(1.0), 0.5 + F.exp(-a * a / 2) / 2.5066282746310002 * series)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def model_cell(status, order, n_exog) -> Column:
    """What a model configuration table shows for a fit."""
    return (
        F.when(status.isNotNull(), "failed")
        .when(order.isNotNull(), F.replace(order, F.lit(" "), F.lit("")))
        .when(F.coalesce(n_exog, F.lit(0)) == 0, "no exogenous")
        .otherwise(n_exog.cast("int").cast("string"))
    )
