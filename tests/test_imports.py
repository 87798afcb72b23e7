"""Imports of many layouts, and amounts in odd forms."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgermill.functions import text as t
from ledgermill.sources import ingest


def test_layouts_of_a_profile_are_read_together(spark, monkeypatch):
    """However many layouts there are, lines are written once and no other frame is for a layout."""
    written = []
    cut = ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda *a, **k: written.append(1) or cut(*a, **k))
    files = [(f"f{i}.csv", bytearray(f"Date,Amount,Payee,Extra {i}\n2024-01-0{i},{i}.50,Shop {i},x\n,,\" \",\n".encode())) for i in range(1, 6)]
    rows = ingest.parse(spark.createDataFrame(files, "path string, content binary")).collect()
    assert len(written) == 1
    assert sorted((r["path"], r["row_number"], r["amount"], r["counterparty_name"], r["raw"][f"extra_{r['path'][1]}"]) for r in rows) == [(f"f{i}.csv", 2, Decimal(f"{i}.50"), f"Shop {i}", "x") for i in range(1, 6)]


def test_amounts_in_odd_forms(spark):
    cases = {"1.234,56": "1234.56", "1,234.56": "1234.56", "12,5": "12.50", "-3": "-3.00", "4-": "-4.00", "EUR +7.1": "7.10", "1.234.567": None, "1,2,3": None, "": None, "-": None, "x": None, "1.2,3.4": None}
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", t.parse_amount(F.col("x")).alias("a"), t.parse_amount(F.col("x"), F.lit("Af")).alias("b")).collect()
    assert {r["x"]: r["a"] for r in got} == {x: None if v is None else Decimal(v) for x, v in cases.items()}
    assert {r["x"]: r["b"] for r in got} == {x: None if v is None else -abs(Decimal(v)) for x, v in cases.items()}
