"""File sources: gauge CSV, JSON shards, embedding parameters and guarded CSV."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL: every NaN of a floating column becomes one."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail at planning time when a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_gauge_csv(spark: SparkSession, path: str, station: str, value: str = "water_level") -> DataFrame:
    """A gauge file with bilingual headers ``Year/..., Month/..., Value/...`` as (station, month, value)."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    by = {c.split("/")[0].strip().lower(): c for c in raw.columns}
    require_columns(raw.select(*[F.col(f"`{c}`").alias(k) for k, c in by.items()]), ["year", "month", "value"])
    year, month, level = (F.col(f"`{by[k]}`") for k in ("year", "month", "value"))
    out = raw.select(F.lit(station).alias("station"), F.make_date(year.try_cast("int"), month.try_cast("int"), F.lit(1)).alias("month"), level.try_cast("double").alias(value))
    return nan_to_null(out.filter("month is not null"))


def read_csv(spark: SparkSession, path: str, schema: str, required: Iterable[str] = ()) -> DataFrame:
    header = spark.read.option("header", True).csv(path)
    require_columns(header, required)
    return nan_to_null(spark.read.option("header", True).schema(schema).csv(path))


def read_json_shards(spark: SparkSession, folder: str, schema: str, expected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards of a folder with the missing and the unexpected keys."""
    found = spark.read.schema(schema).json(folder)
    have = found.select(*keys).distinct()
    return found, expected.join(have, keys, "left_anti"), have.join(expected, keys, "left_anti")


def read_embedding_params(spark: SparkSession, path: str) -> DataFrame:
    """``{entity: {variable: {E, tau, n_obs}}}`` as rows."""
    schema = "struct<E:int,tau:int,n_obs:int,status:string>"
    text = spark.read.option("wholetext", True).text(path)
    outer = text.select(F.explode(F.from_json("value", f"map<string,map<string,{schema}>>")).alias("entity", "vars"))
    return outer.select("entity", F.explode("vars").alias("variable", "p")).select("entity", "variable", "p.*")


def write_embedding_params(params: DataFrame, path: str) -> None:
    """Rows as the one line that ``read_embedding_params`` reads; a table of a row an entity and variable, which is small."""
    cell = F.struct("E", "tau", "n_obs", "status")
    inner = params.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("variable", cell))).alias("vars"))
    whole = inner.agg(F.map_from_entries(F.collect_list(F.struct("entity", "vars"))).alias("m"))
    whole.select(F.to_json("m")).write.mode("overwrite").text(path)
