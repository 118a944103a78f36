"""A stream of tasks turned into resumable shards.

The panel engine has no event-time operators; a stream only delivers tasks or
observations, and each micro-batch runs the batch plan on what isn't done yet.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.runs import append, remaining


def run_tasks(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], config: Mapping, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on the tasks of each batch that have no result yet; a repeated batch adds nothing twice."""

    def batch(tasks: DataFrame, _: int) -> None:
        todo = remaining(tasks.dropDuplicates(list(keys)), path, keys, config).drop("fingerprint")
        if not todo.isEmpty():
            append(work(todo), path, config)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
