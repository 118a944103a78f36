"""Resumable runs: tasks, finished keys and a manifest."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import fingerprint


def config_fingerprint(config: Mapping) -> F.Column:
    """16 hex digits of the configuration as sorted JSON; results of other settings never count as done."""
    return fingerprint(F.lit(json.dumps(config, sort_keys=True, default=str)))


def finished(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(*keys, "fingerprint").distinct()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def remaining(tasks: DataFrame, path: str, keys: Sequence[str], config: Mapping) -> DataFrame:
    """Tasks without a result of this configuration."""
    marked = tasks.withColumn("fingerprint", config_fingerprint(config))
    done = finished(tasks.sparkSession, path, keys)
    return marked if done is None else marked.join(done, [*keys, "fingerprint"], "left_anti")


def append(results: DataFrame, path: str, config: Mapping, by: str | None = None) -> None:
    """Add results of tasks; a run that is started again finds them."""
    writer = results.withColumns({"fingerprint": config_fingerprint(config), "completed_at": F.current_timestamp()}).write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def status(tasks: DataFrame, path: str, keys: Sequence[str], config: Mapping) -> DataFrame:
    """Total, completed and remaining tasks."""
    left = remaining(tasks, path, keys, config).agg(F.count("*").alias("remaining"))
    total = tasks.agg(F.count("*").alias("total"))
    return total.crossJoin(left).select("total", (F.col("total") - F.col("remaining")).alias("completed"), "remaining")


def coverage(found: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, unexpected and repeated keys, none of which a complete result has."""
    have = found.select(*keys)
    parts = [
        expected.select(*keys).join(have, list(keys), "left_anti").withColumn("problem", F.lit("missing")),
        have.join(expected, list(keys), "left_anti").withColumn("problem", F.lit("unexpected")),
        have.groupBy(*keys).count().filter("count > 1").drop("count").withColumn("problem", F.lit("repeated")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def require_inputs(spark: SparkSession, inputs: Mapping[str, tuple[str, str]]) -> None:
    """Fail before any work, naming every input ``name: (format, path)`` that isn't there."""
    missing = []
    for name, (kind, path) in inputs.items():
        try:
            spark.read.format(kind).load(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing.append(f"{name} ({path})")
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def run_steps(spark: SparkSession, steps: Mapping[str, Callable[[], object]]) -> DataFrame:
    """Steps in their order as ``(step, status, seconds, error)``; those after a failed one are skipped, not run."""
    rows, failed = [], False
    for name, step in steps.items():
        if failed:
            rows.append((name, "skipped", None, None))
            continue
        start = time.monotonic()
        try:
            step()
        except Exception as error:  # a failed step is a row of the status table
            failed = True
            rows.append((name, "failed", time.monotonic() - start, str(error).splitlines()[0] if str(error) else type(error).__name__))
        else:
            rows.append((name, "OK", time.monotonic() - start, None))
    return spark.createDataFrame(rows, "step string, status string, seconds double, error string")
