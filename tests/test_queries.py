"""Every registered query with SQL gives DuckDB's rows; the entry points work, with and without the optional subpackage."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from ledgermill.functions import joins
from ledgermill.operators import rules
from ledgermill.plans import registry
from ledgermill.sources import tables


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def sorted_rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_sql(spark, con, sf_dir, name):
    got, want = sorted_rows(registry.QUERIES[name](spark, sf_dir).toPandas()), sorted_rows(con.sql(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)


def test_thousandths_that_end_in_half_a_cent(spark, tmp_path):
    """Prices whose thousandth lies halfway between two cents; the nearest double is now above and now below it."""
    prices = [145.0, 155.0, 136285.0, 154265.0, 1005.0, 1015.0, 499995.0, 1255.0]
    made = [(5 * i, i % 7 + 7 * (i % 3), "F" if i % 2 else "O", prices[i // 2 % len(prices)] + j, pd.Timestamp("1996-01-01"), "5-LOW") for j in (0, 10) for i in range(64 * (j // 10), 64 * (j // 10 + 1))]
    orders = pd.DataFrame(made, columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    spark.createDataFrame(orders).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.register("orders", orders)
    got, want = sorted_rows(registry.QUERIES["cascade_transfer_edges"](spark, str(tmp_path)).toPandas()), sorted_rows(c.sql(registry.ORACLE_SQL["cascade_transfer_edges"]).df())
    assert len(want) and got.values.tolist() == want.values.tolist()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    registry.QUERIES[name](spark, sf_dir).collect()


def test_tables_that_grow_are_not_broadcast_by_their_files_size(spark, con, sf_dir, tmp_path, monkeypatch):
    for module, name in ((tables, "MOST_CUSTOMERS"), (rules, "MOST_RULES"), (rules, "MOST_BROADCAST"), (joins, "FEW_ROWS")):
        monkeypatch.setattr(module, name, 10, raising=False)
    planned = lambda frame: frame._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in planned(tables.ledger_orders(spark, sf_dir))
    spark.range(3000).selectExpr("concat('k', id) AS key", "id AS v").write.parquet(f"{tmp_path}/side")
    rows = spark.range(3000).selectExpr("concat('k', id % 700) AS key", "id")
    assert "SortMergeJoin" in planned(joins.join_spread(rows, spark.read.parquet(f"{tmp_path}/side"), "key"))
    got, want = sorted_rows(registry.QUERIES["rules_many"](spark, sf_dir).toPandas()), sorted_rows(con.sql(registry.ORACLE_SQL["rules_many"]).df())
    assert len(want) and got.values.tolist() == want.values.tolist()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    """In a copy without the subpackage, its tests and the pipeline, the entry point still gives the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/ledgermill", f"{tmp_path}/ledgermill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert out.stdout.split()[-2:] == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))], out.stderr
