"""Every registered query against its SQL."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillmap.plans import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    result = oracle.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, got) == _rows(columns, expected)
    assert got


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["question_id", "rank"] and df.count() > 0


LEFT_OUT = """
import __spark_entry__ as entry
from quillmap.session import local_session

assert not [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"], "llm is still there"
spark = local_session(2, **{"spark.driver.memory": "2g"})
print("rows", entry.queries()["latest_message"](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("gone", [("quillmap/llm", "tests/llm", "corpus_pipeline.py"), ("quillmap/llm", "tests/llm")])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    here = Path(entry.__file__).parent
    left_out = [here / name for name in gone]
    copy = tmp_path / "repo"
    shutil.copytree(here, copy, ignore=lambda at, names: [n for n in names if n == ".git" or Path(at, n) in left_out])
    done = subprocess.run([sys.executable, "-c", LEFT_OUT], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0
