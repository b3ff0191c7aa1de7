"""Every registered relational query against its SQL in DuckDB."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from ashlar.plans import catalog, source_catalog

QUERIES, ORACLE = catalog.QUERIES | source_catalog.QUERIES, catalog.ORACLE | source_catalog.ORACLE


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert norm(tuple(r) for r in df.select([f"`{n}`" for n in names]).collect()) == norm(want.fetchall())


def test_pushdown_and_pruning(spark, sf_dir):
    plan = QUERIES["filter_int_gt"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,30)]" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_top_k_is_no_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in QUERIES["order_by_desc_limit"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    """On a copy without the subpackage, its tests and the pipeline."""
    top = Path(__file__).parent.parent
    shutil.copytree(top / "ashlar", tmp_path / "ashlar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    for with_pipeline in (False, True):
        if with_pipeline:
            if not (top / "corpus_pipeline.py").exists():
                break
            shutil.copy(top / "corpus_pipeline.py", tmp_path)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_star' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q) and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"], "PYTHONPATH": str(tmp_path)}, check=True)
