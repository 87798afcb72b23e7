"""Records that span lines, cells without number, and as-of joins, against plain versions."""

from __future__ import annotations

import csv
import io
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import matching
from ledgermill.sources import ingest


def made_text(rng: random.Random, sep: str) -> str:
    """Rows of cells, some quoted with separators, quotes and newlines in them."""
    out = []
    for _ in range(rng.randint(1, 30)):
        cells = []
        for _ in range(rng.randint(3, 6)):
            plain = "".join(rng.choice("ab 1é") for _ in range(rng.randint(1, 5)))
            cells.append(rng.choice([plain, '"' + plain.replace("a", '""').replace("b", rng.choice(["\n", "\n\n", sep, " "])) + '"', '""', plain + '"' + plain]))
        out.append(sep.join(cells))
    return "\n".join(out)


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_records_equal_csv(spark, piece):
    rng = random.Random(piece)
    files = [(f"f{i}", sep := rng.choice(",;\t"), made_text(rng, sep)) for i in range(25)]
    lines = spark.createDataFrame([(p, s, n, x) for p, s, t in files for n, x in enumerate(t.split("\n"), 1)], "path string, sep string, row_number int, line string").repartition(4)
    got: dict = {}
    for r in ingest.joined_records(lines, piece).collect():
        got.setdefault(r["path"], []).append((r["row_number"], r["line"]))
    for path, sep, text in files:
        want = list(csv.reader(io.StringIO(text), delimiter=sep))
        rows = sorted(got[path])
        assert "\n".join(x for _, x in rows) == text
        assert [next(csv.reader(io.StringIO(x), delimiter=sep), []) for _, x in rows] == want


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_cells_equal_csv(spark, sep):
    rng = random.Random(9)
    records = [x for _ in range(30) for x in made_text(rng, sep).split("\n") if list(csv.reader(io.StringIO(x + "\nS"), delimiter=sep))[1:] == [["S"]]]  # those that end outside quotes
    records += [sep.join(["a"] * 300), sep, f'"x{sep}y"{sep}', f'{sep}{sep}"q""q"', "one", '"' + "z" * 20_000 + '"' + sep + "b"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(records)], "i int, line string")
    for r in frame.select("line", ingest.cells(F.col("line"), sep).alias("cells")).collect():
        assert r["cells"] == next(csv.reader(io.StringIO(r["line"]), delimiter=sep), [""]), r["line"]


def test_file_with_long_rows_and_cells_over_lines(spark):
    more = ",".join(f"m{i}" for i in range(40))
    text = f'Date,Account,Counterparty,Amount,Currency,Description\n2024-01-05,A,"Shop, of ""all""",1.00,EUR,"first\nsecond",{more}\n\n2024-01-06,A,Shop,-2.00,EUR,plain\n'
    rows = ingest.parse(spark.createDataFrame([("x.csv", bytearray(text.encode()))], "path string, content binary")).orderBy("row_number").collect()
    assert [(r["row_number"], float(r["amount"]), r["counterparty_name"]) for r in rows] == [(2, 1.0, 'Shop, of "all"'), (5, -2.0, "Shop")]
    assert rows[0]["description"].split() == ["first", "second", *[f"m{i}" for i in range(40)]]


def plain_asof(rows, values):
    out = {}
    for i, k, t in rows:
        best = max(((vt, v) for vk, vt, v in values if vk == k and v is not None and t is not None and vt <= t), default=None) if k is not None else None
        out[i] = best[1] if best else None
    return out


@pytest.mark.parametrize("kind", ["date", "timestamp"])
@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_asof_equals_plain(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(matching, "MOST_BROADCAST", limit)
    rng = random.Random(1)
    moment = (lambda: date(2024, 1, 1) + timedelta(days=rng.randrange(90))) if kind == "date" else (lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(90 * 24)))
    rows = [(i, rng.choice(["a", "a", "b", "none", None]), None if i == 5 else moment()) for i in range(300)]
    values = [(rng.choice("ab"), moment(), rng.choice([None, rng.random()])) for _ in range(60)]
    left = spark.createDataFrame(rows, f"i int, k string, t {kind}")
    right = spark.createDataFrame(values, f"k string, at {kind}, v double")
    got = {r["i"]: r["out"] for r in matching.asof(left, right, "k", "t", "at", "v", "out").collect()}
    assert got == plain_asof(rows, values)


def test_asof_has_no_window_over_a_key(spark):
    """A row's own value is joined; windows are over days of a key, or rows of a day."""
    left = spark.createDataFrame([(1, "a", date(2024, 1, 2))], "i int, k string, t date")
    plan = matching.asof(left, spark.createDataFrame([("a", date(2024, 1, 1), 1.0)], "k string, at date, v double"), "k", "t", "at", "v", "out")._jdf.queryExecution().toString()
    assert "Window" not in plan
