"""Batches that are tried again, broken off, or read before the first one."""

from __future__ import annotations

from ledgermill.functions import storage
from ledgermill.sources import batches, ingest

HEAD = "Date,Account,Counterparty,Amount,Currency,Description\n"


def files(spark, *named):
    return spark.createDataFrame([(p, bytearray((HEAD + rows).encode())) for p, rows in named], "path string, content binary")


def test_batches_are_whole_and_once(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    assert [batches.read(spark, folder, t) for t in ("transactions", "accounts")] == [None, None]
    one = files(spark, ("a.csv", "2024-01-05,A,Shop,1.00,EUR,x\n"), ("b.csv", "2024-01-06,B,Shop,2.00,EUR,y\n"))
    name = batches.batch_name(one)
    assert name == batches.batch_name(one.orderBy("path", ascending=False)) != batches.batch_name(one.limit(1))
    first = ingest.import_files(one)
    first.transactions.limit(1).write.parquet(f"{folder}/transactions/batch={name}")  # broken off before its line in the manifest
    assert batches.read(spark, folder, "transactions") is None
    assert batches.commit(first, folder, name) and not batches.commit(first, folder, name)
    assert batches.read(spark, folder, "transactions").count() == 2
    two = files(spark, ("c.csv", "2024-01-05,A,Shop,1.00,EUR,x\n2024-02-05,C,Shop,3.00,EUR,z\n"))
    second = ingest.import_files(two, *[batches.read(spark, folder, t) for t in ("files", "accounts", "transactions")])
    second.transactions.write.parquet(f"{folder}/transactions/batch=lost")
    assert batches.read(spark, folder, "transactions").count() == 2
    assert batches.commit(second, folder, batches.batch_name(two))
    rows = {(r["path"], float(r["amount"])): r["is_duplicate"] for r in batches.read(spark, folder, "transactions").collect()}
    assert rows == {("a.csv", 1.0): False, ("b.csv", 2.0): False, ("c.csv", 1.0): True, ("c.csv", 3.0): False}
    assert {r["account_name"] for r in batches.read(spark, folder, "accounts").collect()} == {"A", "B", "C"}
    assert [r["position"] for r in batches.manifest(spark, folder).orderBy("position").collect()] == [1, 2]


def test_files_balances_and_accounts_take_no_part_in_duplicates(spark, monkeypatch):
    """Rows are written once, without what tells duplicates; only the transactions join by fingerprint."""
    written = []
    monkeypatch.setattr(ingest, "cut", lambda frame, by=None: written.append(frame.columns) or storage.cut(frame, by))
    made = ingest.import_files(files(spark, ("a.csv", "2024-01-05,A,Shop,1.00,EUR,x\n"), ("b.csv", "2024-01-05,A,Shop,1.00,EUR,x\n2024-01-06,B,Shop,2.00,USD,y\n"), ("c.csv", "2024-01-05,A,Shop,1.00,EUR,x\n2024-01-06,A,Shop,3.00,EUR,z\n")))
    assert sum("raw" in columns for columns in written) == 1 and not any("is_duplicate" in columns for columns in written)
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    assert all("last_path" not in plan(frame) for frame in (made.files, made.amount_details, made.balances, made.accounts))
    rows = {(r["path"], r["row_number"]): (r["is_duplicate"], r["duplicate_of"] and r["duplicate_of"]["path"]) for r in made.transactions.collect()}
    assert rows == {("a.csv", 2): (False, None), ("c.csv", 2): (True, "a.csv"), ("c.csv", 3): (False, None)}
    assert {r["path"]: r["error"] for r in made.files.collect()} == {"a.csv": None, "b.csv": "row 3: no rate for USD", "c.csv": None}
