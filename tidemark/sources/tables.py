"""The driver's tables seen as panels: long frames keyed by entity and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ("P", "RegFlow", "Temp", "R", "SWE", "Evap")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _located_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nation and region; the three dimension tables are small beside them."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))


def station_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed months of every station (nation) of an entity (region): the mean order."""
    return (
        _located_orders(spark, sf_dir)
        .groupBy(F.col("r_name").alias("entity"), F.col("n_name").alias("station"), F.trunc("o_orderdate", "MM").alias("month"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def driver_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six predictor variables by entity and month of shipping."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    placed = _located_orders(spark, sf_dir).select("o_orderkey", F.col("r_name").alias("entity"))
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("entity", F.trunc("l_shipdate", "MM").alias("month"))
        .agg(
            F.sum("l_quantity").alias("P"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("RegFlow"),
            F.avg("l_discount").alias("Temp"),
            F.avg("l_tax").alias("R"),
            F.countDistinct("l_orderkey").cast("double").alias("SWE"),
            F.avg("l_extendedprice").alias("Evap"),
        )
    )


def supplier_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly quantity of every supplier: many entities, with real gaps."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("entity"), F.trunc("l_shipdate", "MM").alias("month")).agg(F.avg("l_quantity").alias("x"))


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean of the event values by type; ``t`` counts hours from the first event."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), "value")
    hourly = events.groupBy("entity", "hour").agg(F.avg("value").alias("x"))
    first = hourly.agg(F.min("hour").alias("h0"))
    return hourly.crossJoin(F.broadcast(first)).select("entity", (F.col("hour") - F.col("h0")).cast("int").alias("t"), "x")


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic directed edges between consecutive nations of a region, closed to a cycle in two regions."""
    nation = table(spark, sf_dir, "nation")
    places = nation.select("n_regionkey", F.col("n_nationkey").alias("src"))
    nxt = nation.select("n_regionkey", F.col("n_nationkey").alias("dst"))
    later = places.join(nxt, "n_regionkey").filter("dst > src").groupBy("n_regionkey", "src").agg(F.min("dst").alias("dst"))
    back = places.groupBy("n_regionkey").agg(F.max("src").alias("src"), F.min("src").alias("dst")).filter("n_regionkey < 2").select("n_regionkey", "src", "dst")
    return later.unionByName(back).select(F.col("n_regionkey").alias("entity"), "src", "dst", (F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(16)) - 4).alias("lag"))
