"""Every registered query against its SQL."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in records)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    frame = queries()[name](spark, SF)
    got = frame.collect()
    if name in oracle_sql():
        relation = db.sql(oracle_sql()[name])
        assert sorted(frame.columns) == sorted(relation.columns)
        assert rows(frame.columns, got) == rows(relation.columns, relation.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry(spark).columns == ["thread_id", "segment", "text"]


def test_all_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_core_queries_need_no_training_operators(tmp_path):
    here = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
    shutil.copytree(os.path.join(here, "mailspark"), tmp_path / "mailspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(here, name), tmp_path)
    script = (
        "from __spark_entry__ import entry, oracle_sql, queries\n"
        "from mailspark.session import local_session\n"
        f"print(len(queries()), 'pipeline' in queries(), queries()['thread_metadata'](local_session('t', 2, 2), {SF!r}).count())"
    )
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    number, pipeline, found = out.stdout.split()[-3:]
    assert int(number) > 40 and pipeline == "False" and int(found) > 0
