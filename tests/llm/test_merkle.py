"""The manifest against a tree built row by row."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from ledgermill.llm import merkle
from ledgermill.llm.queries import ORACLE_SQL, op13_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node int, at long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)

    def build(nodes: list[str]) -> list[list[str]]:
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def beside(levels: list[list[str]], i: int) -> list[tuple[list[str], int]]:
        return [(level[i // 8**k // 8 * 8 : i // 8**k // 8 * 8 + 8], i // 8**k % 8) for k, level in enumerate(levels[:-1])]

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: build([leaf(r) for r in groups[g]]) for g in names}
    top = build([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            runs = beside(trees[g], i) + beside(top, j)
            proof = sha("".join(h for run, slot in runs for k, h in enumerate(run) if k != slot))
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            h = leaf((*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]))) if changed else leaf(row)
            for run, slot in runs:
                h = sha("".join(h if k == slot else x for k, x in enumerate(run)))
            out.append((row[0], leaf(row), trees[g][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def result(spark, rows: list[tuple], tmp_path, parts: int = 3) -> list[tuple]:
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(parts)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return [tuple(r[c] for c in columns) for r in op13_merkle_manifest(spark, str(tmp_path)).collect()]


def made(sizes: dict) -> list[tuple]:
    return [(i * 7 % 1009 + 1009 * k, f"s{i % 3}" if i % 4 else None, g, i, f"Text {i} É {'x' * (i % 50)}") for k, (g, n) in enumerate(sizes.items()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "fr": 1}, {"en": 600, None: 65, "": 64, "é": 1, "z": 513}, {f"l{i}": i % 10 + 1 for i in range(70)}])
def test_equals_plain_tree(spark, tmp_path, sizes):
    rows = made(sizes)
    assert Counter(result(spark, rows, tmp_path)) == Counter(plain(rows))


def test_nulls_ties_and_long_texts(spark, tmp_path):
    rows = [(3, None, None, None, None), (None, "s", "en", 4, "A"), (None, "s", "en", 4, "B"), (5, "s", "en", 4, ""), (5, "s", "en", 4, ""), (5, "t", "en", 4, ""), (6, "漢", "en", -1, "X" * 100_000), (-12, "s", "fr", 0, "ABC")]
    assert Counter(result(spark, rows, tmp_path)) == Counter(plain(rows))


def test_starts_joined_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "MOST_BROADCAST", 0)
    rows = made({"en": 100, "fr": 30})
    assert Counter(result(spark, rows, tmp_path)) == Counter(plain(rows))


def test_empty(spark, tmp_path):
    assert result(spark, [], tmp_path, 1) == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r[c] for c in columns) for r in op13_merkle_manifest(spark, sf_dir).collect()) == Counter(plain([tuple(r) for r in docs]))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op13_merkle_manifest"])
    rows = op13_merkle_manifest(spark, sf_dir).select(*want.columns).collect()
    assert Counter(map(tuple, rows)) == Counter(want.fetchall())
