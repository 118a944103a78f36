"""The registry works without the corpus operators, and queries agree with SQL at the smallest scale."""

from __future__ import annotations

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("month_offset", "gap_fill_linear", "bh_fdr", "components", "point_in_polygon", "model_config_pivot", "foresight_flags", "hash_fingerprint", "resolve_polygon", "grid_cells", "edge_entity_counts", "acquisition_status", "missing_edges", "average_tie_rank", "ancestors", "panel_extent")


def test_imports_without_corpus_operators(tmp_path):
    """In a copy without the corpus operators all else is registered; a module missing elsewhere is an error."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = """
import __spark_entry__ as e
names = e.queries()
assert names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy)
    (copy / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True).returncode != 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    from tidemark.queries import QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    query = QUERIES[name]
    found = query.run(spark, SF)
    result = con.execute(query.sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v

    def rows(every, at):
        return sorted((tuple(str(plain(r[i])) for i in at) for r in every))

    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert rows(found.select(*sorted(columns)).collect(), range(len(columns))) == rows(result.fetchall(), order)
