"""Every registered query equals its SQL counterpart on the smallest given tables."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import SMOKE_FOLDER, entry, oracle_sql, queries
from shiftlens.catalog.oracles import ORACLES
from shiftlens.catalog.queries import QUERIES
from shiftlens.plans.scratch import drop_scratch
from tools.check_queries import TABLES, _rows

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def test_entry(spark, folder):
    result = entry(spark)
    assert result.count() > 0 and not {"puid", "id", "shift_id"} & {c.lower() for c in result.columns}


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, name):
    df = queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    expected = db.sql(oracle_sql()[name])
    names, rows = list(expected.columns), expected.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, got) == _rows(names, rows)


def test_queries_run_after_scratch_is_dropped(spark, folder):
    before = sorted(map(tuple, queries()["store_count"](spark, folder).collect()))
    drop_scratch(spark)
    assert sorted(map(tuple, queries()["store_count"](spark, folder).collect())) == before


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session of its own, started elsewhere, whose workers know nothing of this folder."""
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('__spark_entry__', {str(ROOT / '__spark_entry__.py')!r})\n"
        "entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)\n"
        "from pyspark.sql import SparkSession\n"
        f"spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.warehouse.dir', {str(tmp_path)!r}).getOrCreate()\n"
        f"print('rows', entry.queries()['topk_per_source'](spark, {SMOKE_FOLDER!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert re.search(r"rows \d+", out.stdout), out.stderr[-2000:]


def test_entry_works_without_the_llm_folders(tmp_path):
    """A copy without the subpackage still imports and registers every other query, pipeline file or not."""
    for part in ("shiftlens", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), set(e.oracle_sql()) == set(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.split() == ["True", "True"], out.stderr[-2000:]
