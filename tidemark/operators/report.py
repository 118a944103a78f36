"""Report tables and text sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import model_cell


def supported_drivers(edges: DataFrame, order: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Significant edges (negative lags too) with display names, rounding and a domain order."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("cause"))
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    shown = F.coalesce(name[F.col("cause")], F.col("cause")) if name is not None else F.col("cause")
    return edges.filter("significant").select(
        F.when(place == 0, len(order) + 1).otherwise(place).cast("long").alias("place"),
        shown.alias("driver"),
        "effect",
        F.round("obs_rho", 3).alias("rho"),
        F.format_string("%+d", F.col("obs_lag").cast("int")).alias("lag"),
        F.format_string("%.1e", "p_fdr").alias("p_fdr"),
        F.when(F.col("causal_evidence"), "Yes").otherwise("No").alias("evidence"),
    )


def configurations(fits: DataFrame, key: str, methods: Sequence[str], status: str = "status", order: str = "model_order", n_exog: str = "n_exog") -> DataFrame:
    """One row a key, one column a method: the fitted configuration, or ``not applicable``."""
    cells = fits.withColumn("_cell", model_cell(F.col(status), F.col(order), F.col(n_exog)))
    return cells.groupBy(key).pivot("method", list(methods)).agg(F.min("_cell")).na.fill("not applicable")


def text_cells(df: DataFrame, decimals: int | Mapping[str, int] = 3) -> DataFrame:
    """Every column as the text a report shows: fixed decimals (by column, if given so), ``%.2e`` below 1e-4, yes or no, blank for null."""
    shown = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.BooleanType):
            text = F.when(c, "yes").otherwise("no")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            digits = decimals if isinstance(decimals, int) else decimals.get(field.name, 3)
            x = c.cast("double")
            text = F.when((x != 0) & (F.abs(x) < 1e-4), F.format_string("%.2e", x)).otherwise(F.format_string(f"%.{digits}f", x))
        else:
            text = F.replace(c.cast("string"), F.lit("|"), F.lit("\\|"))
        shown.append(F.when(c.isNull(), "").otherwise(text).alias(field.name))
    return df.select(*shown)


def to_markdown(df: DataFrame, decimals: int | Mapping[str, int] = 3) -> str:
    """A report table, which is small, as Markdown; the schema says which columns align right."""
    lines = text_cells(df, decimals).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(f"`{c}`") for c in df.columns]), F.lit(" |")).alias("line"))
    right = ["---:" if isinstance(f.dataType, T.NumericType) else "---" for f in df.schema.fields]
    return "\n".join(["| " + " | ".join(x) + " |" for x in (df.columns, right)] + [r.line for r in lines.collect()])


def report(parts: Mapping[str, DataFrame], notes: Mapping[str, str] | None = None) -> str:
    """One document: a heading, the table and a note for each part."""
    notes = notes or {}
    return "\n\n".join("\n\n".join(x for x in (f"## {title}", to_markdown(df), notes.get(title, "")) if x) for title, df in parts.items()) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    """One headed file; for result tables, which are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def checks(assertions: Mapping[str, DataFrame]) -> DataFrame:
    """``(check, ok)``: an assertion holds if its frame, the offending rows, is empty."""
    spark = next(iter(assertions.values())).sparkSession
    return spark.createDataFrame([(name, df.isEmpty()) for name, df in assertions.items()], "check string, ok boolean")
