"""How many files, and so processes, stored tables take."""

from __future__ import annotations

from pathlib import Path

from tidemark.llm import decontaminate
from tidemark.llm.graph import connected_components
from tidemark.llm.store import Scratch


def _files(spark, name):
    """Part files and checksum files by table, of the operator's last call."""
    last = max(Path(spark.conf.get("spark.checkpoint.dir"), "tidemark").glob(f"{name}-*"), key=lambda p: p.stat().st_ctime_ns)
    return {t.name[4:]: (len(list(t.glob("part-*"))), len(list(t.glob(".part-*")))) for t in sorted(last.iterdir())}


def _many(spark):
    for k, v in (("spark.sql.shuffle.partitions", "64"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before = spark.conf.get(k)
        spark.conf.set(k, v)
        yield k, before


def test_decontamination_stores_small_tables_in_few_files(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    item = " ".join(words[:12]) + " 17 apples and 21 pears"
    docs = spark.createDataFrame([(i, f"text {i} says {item} twice") for i in range(300)] + [(1000, "no leak at all")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (2, " ".join(words[30:50]))], "item_id long, text string")
    before = dict(_many(spark))
    try:
        found = decontaminate.leaks(docs, benchmark)
        n, ids = found.rdd.getNumPartitions(), sorted(r.doc_id for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ids == list(range(300))
    few = spark.sparkContext.defaultParallelism
    stored = _files(spark, "decontaminate")
    assert n <= few and all(stored[t][0] <= few for t in ("placed", "asked", "values"))
    assert not any(checksums for _, checksums in stored.values())


def test_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.store.ROWS_A_FILE", 100)
    rows = spark.range(0, 1000, 1, 40)
    kept = Scratch(spark, "store-test").table(rows, "t", 1000)
    assert kept.count() == 1000 and len(kept.inputFiles()) == 10
    assert len(Scratch(spark, "store-test").table(rows, "t").inputFiles()) == 40


def test_components_store_small_tables_in_few_files(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 400) if i % 50 != 49], "a long, b long")
    before = dict(_many(spark))
    try:
        label = {r.node: r.component for r in connected_components(chain, Scratch(spark, "components-test")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert label == {i: i // 50 * 50 for i in range(400)}
    stored = _files(spark, "components-test")
    assert {"up", "jump"} <= set(stored)
    assert all(parts <= spark.sparkContext.defaultParallelism for t, (parts, _) in stored.items() if t in ("up", "jump"))
