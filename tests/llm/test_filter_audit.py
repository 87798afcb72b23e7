"""The audit against a plain replay of every order, and its SQL."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import duckdb
import pandas as pd
import pytest

from ledgermill.llm import filter_audit, grouping
from ledgermill.llm.queries import ORACLE_SQL, op12_filter_audit

SCHEMA = "doc_id long, text string, source string, part string, digest int"


def plain(rows: list[tuple], labels: dict[int, tuple]) -> dict[tuple, tuple]:
    """Every order replayed document by document."""
    docs = []
    for doc_id, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        repeats = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": repeats}
        quality, toxic = labels.get(doc_id, (0, 0))
        docs.append((source or "", fails, quality == 1, toxic == 1))
    out = {}
    shares = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            gone: list = []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                only = sum(d[0] == part and d[1][x] and sum(d[1].values()) == 1 for d in docs)
                out[part, order, step] = [len(left), len(removed), sum(d[1][x] for d in gone), only, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shares[part, x] += len(removed)
                gone += removed
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    long, dull = " ".join(f"w{i}" for i in range(250)), "same words " * 150
    texts = [None, "", long, long, long + " #", dull, dull, "A B C", long.upper(), long + "\x0b\x1cmore words", "x" * 9000, "漢字 " * 300, long]
    made = [(i, t, ("s", None, "")[i % 3], "clash", 9) for i, t in enumerate(texts)]
    return [*made, made[2], (None, long, "s", "clash", 9), (None, long, "s", "clash", 9)]


@pytest.mark.parametrize("few", [100_000, 0])
def test_equals_plain_replay(spark, rows, monkeypatch, few):
    """Also where every text is joined as if the table were large."""
    monkeypatch.setattr(grouping, "FEW_ROWS", few)
    labels = {2: (1, 0), 3: (1, 1), 5: (0, 1), 7: (1, None), 12: (None, 1)}
    marks = spark.createDataFrame([*[(k, *v) for k, v in labels.items()], (3, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = filter_audit.replay(filter_audit.document_flags(frame, marks), lost=("good", "toxic")).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got}
    assert len(got) == len(found) == 2 * 600
    assert found == plain(rows, labels)


def test_flags_carry_no_text(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    flags = filter_audit.document_flags(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert set(flags.columns) == {"part", "A", "B", "C", "D", "E", "good", "toxic"}  # no text is crossed


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert filter_audit.replay(filter_audit.document_flags(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = op12_filter_audit(spark, sf_dir).toPandas(), con.sql(ORACLE_SQL["op12_filter_audit"]).df()
    key = ["part", "filter_order", "step"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want[got.columns].sort_values(key, ignore_index=True), check_dtype=False)
