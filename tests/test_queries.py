import importlib
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import lexiloom.operators.ordering as ordering
from lexiloom.operators.ordering import with_neighbours, with_running_sum
from lexiloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations benchmark".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_its_sql(spark, con, name):
    found = catalog.QUERIES[name](spark, SF)
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    columns = sorted(found.columns)
    mine = sorted(str([rounded(r[c]) for c in columns]) for r in found.collect())
    if name not in catalog.ORACLES:
        assert mine
        return
    told = con.sql(catalog.ORACLES[name])
    assert columns == sorted(told.columns)
    at = [told.columns.index(c) for c in columns]
    assert mine == sorted(str([rounded(r[k]) for k in at]) for r in told.fetchall())


def test_neighbours_and_sums_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 7)
    rows = spark.range(100).select((F.col("id") * 3).alias("k"), (F.col("id") % 5).alias("v"))
    found = {r.k: r for r in with_neighbours(rows, "k", ["v"]).collect()}
    assert all(found[k].next_v == ((k // 3 + 1) % 5 if k < 297 else None) and found[k].prev_v == ((k // 3 - 1) % 5 if k else None) for k in found)
    sums = {r.k: r.s for r in with_running_sum(rows, "k", "v", "s").collect()}
    assert all(sums[3 * i] == sum(j % 5 for j in range(i)) for i in range(100))


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


RUN = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print(len(e.queries()), len(e.oracle_sql()), e.queries()["integration_costs"](spark, "").count())
"""


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without lexiloom/llm and corpus_pipeline.py still imports, lists its queries and runs them."""
    from pathlib import Path
    from shutil import copytree, ignore_patterns

    root = Path(importlib.import_module("lexiloom").__file__).resolve().parents[1]
    copytree(root / "lexiloom", tmp_path / "lexiloom", ignore=ignore_patterns("llm", "__pycache__"))
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    told = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert told.returncode == 0, told.stderr
    assert told.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "6"]
