"""Decontamination, pieces, fingerprints and the pipeline against plain versions, with the odd cases."""

from __future__ import annotations

import functools
import hashlib
import random
import struct

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgermill.llm import decontaminate, fingerprints, pieces
from ledgermill.llm.queries import op1_decontaminate, op9_fingerprints

from .conftest import prose
from .test_dedup import normal


def plain_tiles(item: list, doc: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by comparing all pairs of places."""
    item_free, doc_free, found = [True] * len(item), [True] * len(doc), []
    while True:
        best, at = least - 1, None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and item_free[i + n] and doc_free[j + n]:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if at is None:
            return found
        for k in range(best):
            item_free[at[0] + k] = doc_free[at[1] + k] = False
        found.append((*at, best))


def test_tiles_against_all_places():
    rng = random.Random(2)
    for _ in range(60):
        item, doc = ([rng.randint(0, 6) for _ in range(rng.randint(0, 40))] for _ in range(2))
        least = rng.choice([1, 2, 3])
        as_array = lambda x: np.array(x, np.uint64)
        assert decontaminate.tiles(as_array(item), as_array(doc), least) == plain_tiles(item, doc, least)


def leaks(spark):
    rng = random.Random(6)
    items = [prose(rng, rng.randint(20, 40)) for _ in range(8)] + ["kasto", "", None]
    halves = items[1].split()
    half = len(halves) // 2
    texts = [
        prose(rng, 50),
        f"{prose(rng, 20)} {items[0]} {prose(rng, 20)}",
        f"{' '.join(halves[half:])} {prose(rng, 30)} {' '.join(halves[:half])}",  # reordered
        f"{prose(rng, 10)} {' '.join(items[2].split()[:5])} {prose(rng, 10)}",  # a fifth of an item
        None,
        "",
        items[3].upper(),
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), benchmark, texts, items


def test_contaminations_against_plain_tiling(spark):
    docs, benchmark, texts, items = leaks(spark)
    wanted = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            words = list(normal(item))
            covered = sum(n for *_, n in plain_tiles(words, list(normal(t)), min(decontaminate.MIN_MATCH, len(words)))) if words else 0
            if words and covered / len(words) >= decontaminate.COVERAGE:
                wanted[d, i] = (covered, len(words))
    assert {(1, 0), (2, 1), (6, 3)} <= set(wanted) and (3, 2) not in wanted
    for bound in (decontaminate.MAX_BROADCAST_BYTES, 0):  # by broadcast and by join
        found = decontaminate.contaminations(docs, benchmark, max_broadcast_bytes=bound).collect()
        assert {(r["doc_id"], r["item_id"]): (r["n_covered"], r["n_tokens"]) for r in found} == wanted
        kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark, max_broadcast_bytes=bound).collect()}
        assert kept == set(range(len(texts))) - {d for d, _ in wanted}


def test_contaminations_odd_cases(spark, docs, empty, texts):
    _, benchmark, _, _ = leaks(spark)
    no_items = benchmark.limit(0)
    assert decontaminate.contaminations(empty, benchmark).count() == 0
    assert decontaminate.contaminations(docs, no_items).count() == 0
    left = decontaminate.drop_contaminated(docs, no_items)
    assert left.columns == docs.columns and left.count() == len(texts) + 1


def test_contaminations_query(spark, sf_dir):
    rows = op1_decontaminate(spark, sf_dir)
    assert rows.columns == ["doc_id", "item_id", "coverage", "n_tokens", "n_covered", "n_tiles"]
    assert rows.where("coverage < 0.6 or coverage > 1").count() == 0


@pytest.fixture(scope="module")
def table():
    return pieces.load()


def test_pieces_are_the_best_segmentation(table):
    """Against plain dynamic programming over the model's pieces and scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    score = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    for text in ["Hello world", "internationalisation  of  words", "aaaaaaa bbbbb", "the quick brown fox jumps over the lazy dog"]:
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(marked)
        for end in range(1, len(marked) + 1):
            for size in range(1, min(end, table.longest) + 1):
                own = marked[end - size : end]
                if own in score:
                    best[end] = max(best[end], best[end - size] + score[own])
        ids, counts = pieces.encode_texts([text], table)
        assert sum(model.get_score(int(i)) for i in ids) == pytest.approx(best[-1], abs=1e-2)
        assert counts.tolist() == [len(ids)]


def test_pieces_round_trip(spark, docs, empty, texts, table):
    rows = pieces.encode(docs, table, check="same")
    assert rows.columns == [*docs.columns, "ids", "same"]
    assert rows.where("not same").count() == 0
    decoded = pieces.decode(rows, table).collect()
    assert all(r["decoded"] == r["text"] for r in decoded)
    assert [r["ids"] for r in decoded if r["text"] is None] == [None]
    assert [r["ids"] for r in decoded if r["text"] == ""] == [[]]
    assert pieces.encode(empty, table).count() == 0 == pieces.decode(pieces.encode(empty, table), table).count()


def test_fingerprints_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op9_fingerprints(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(texts)
    errors = []
    for i, doc_id in enumerate(order):
        own, after = texts[doc_id], texts[order[(i + 1) % len(order)]]
        n = len(own) // 3
        edited = own[: len(own) - n] + after[:n]
        r = rows[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b = ({w[k : k + 5] for w in [normal(t)] for k in range(max(1, len(w) - 4))} for t in (own, edited))
        errors.append(r["near_edited"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    same = {}
    for doc_id, r in rows.items():
        assert same.setdefault(texts[doc_id], r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_odd_cases(spark, docs, empty, texts):
    rows = fingerprints.fingerprints(docs)
    assert rows.columns == [*docs.columns, "fingerprint"] and rows.count() == len(texts) + 1
    assert {r["fingerprint"] for r in rows.collect() if not normal(r["text"])} == {""}
    assert fingerprints.fingerprints(empty).count() == 0
    follow = fingerprints.with_next(docs.select("doc_id", "text"), "doc_id", ["text"])
    assert follow.count() == len(texts) + 1
    assert fingerprints.with_next(empty.select("doc_id", "text"), "doc_id", ["text"]).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert fingerprints.with_next(one, "doc_id", ["text"]).first()["next_text"] == "a b"


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    texts = [prose(rng, 80) for _ in range(30)]
    item = prose(rng, 30)
    texts += [texts[0], texts[1] + " end", f"{prose(rng, 30)} {item}", "12 34 56", None, f"{prose(rng, 40)}\nthe very same line in two documents\n{prose(rng, 9)}", f"{prose(rng, 40)}\nthe very same line in two documents"]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pieces"]
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(done) == set(range(37)) - {30, 31, 32, 33, 34}  # 30 is a copy whose only line went, and with it the document
    assert all(r["round_trip"] for r in done.values())
    table = pieces.load()
    ids = done[36]["ids"]
    assert pieces.decode_ids(np.array(ids, np.int32), np.array([len(ids)]), table)[0] == texts[36].split("\n")[0]


def test_next_rows_of_ids_of_any_type_and_of_none(spark):
    """Text ids follow one another as texts do; rows without an id lie in several blocks and come last."""
    rows = [(f"doc-{i:04d}", f"text {i}", "mine") for i in range(300)] + [(None, f"nameless {i}", "mine") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, id_block string").repartition(4)
    out = fingerprints.with_next(frame, "doc_id", ["text"])
    assert out.columns == ["doc_id", "text", "id_block", "next_text"]
    follows = {r["text"]: r["next_text"] for r in out.collect()}
    assert [follows[f"text {i}"] for i in range(299, 0, -1)] == [f"text {i}" for i in range(298, -1, -1)]
    at, seen = follows["text 0"], []
    while at.startswith("nameless"):
        seen.append(at)
        at = follows[at]
    assert len(set(seen)) == 200 == len(seen) and at == "text 299"


@pytest.mark.parametrize("dtype", ["smallint", "decimal(9,2)", "date", "string", "bigint"])
def test_contaminations_of_items_with_ids_of_any_type(spark, dtype):
    rng = random.Random(3)
    item = prose(rng, 20)
    one = "date'2024-05-06'" if dtype == "date" else f"cast(7 as {dtype})"
    items = spark.createDataFrame([(item,)], "text string").selectExpr(f"{one} as item_id", "text")
    frame = spark.createDataFrame([(1, f"{prose(rng, 9)} {item}"), (2, prose(rng, 30))], "doc_id long, text string")
    ways = [decontaminate.contaminations(frame, items), decontaminate.contaminations(frame, items, max_broadcast_bytes=0)]
    assert all(dict(x.dtypes)["item_id"] == dtype for x in ways)
    rows = [sorted(map(tuple, x.select("doc_id", "item_id", "n_covered").collect())) for x in ways]
    assert rows[0] == rows[1] and len(rows[0]) == 1 and rows[0][0][2] == 20


def test_pipeline_stages_keep_columns(spark, docs, empty, sf_dir):
    for frame in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf_dir).columns == frame.columns
        assert corpus_pipeline.STAGES[-1][1](spark, frame.withColumn("n_chars", F.lit(0)), sf_dir).count() == frame.count()


def plain_signature(text: str) -> list[int]:
    """The bins of a text, shingle by shingle and bin by bin."""
    chain = lambda parts: functools.reduce(lambda seed, x: xxhash.xxh64(x, seed=seed).intdigest(), parts, 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [[" ".join(words)]] if words else []
    hashes = [chain([w.encode() for w in x]) for x in shingles]
    filled: dict[int, int] = {}
    for x in hashes:
        number = x >> fingerprints._BIN_SHIFT
        filled[number] = min(filled.get(number, x), x)
    out = []
    for j in range(fingerprints.BINS if filled else 0):
        rank = lambda b: (signed(chain([struct.pack("<q", b), struct.pack("<i", j)])), signed(filled[b]))  # noqa: E731, B023
        out.append(filled[j if j in filled else min(filled, key=rank)] & (2**fingerprints.BITS - 1))
    return out


def test_fingerprints_against_plain_signature(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefé漢") * rng.randint(1, 4) for _ in range(n)) for n in (0, 1, 4, 5, 6, 30, 200, 3000)] + ["A, b; C", "x " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["bins"] for r in rows.select("doc_id", fingerprints.signature(F.col("text")).alias("bins")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_signature(x) for x in texts]


def test_text_ids_with_a_common_beginning(spark):
    """Ids that differ in their last characters only fall into many small blocks, one id of a third of the rows too, and the next rows are those of one sort."""
    ids = [f"document-number-{i:06d}" for i in range(2000)] + ["document-number-000700"] * 1000
    rows = spark.createDataFrame([(x, f"text {i}") for i, x in enumerate(ids)], "doc_id string, text string").repartition(5)
    hashed = F.xxhash64("text")
    sizes = [r["count"] for r in rows.groupBy(fingerprints.id_blocks(rows, "doc_id", hashed).alias("block")).count().collect()]
    assert len(sizes) > 500 and max(sizes) <= 30
    keyed = sorted(((r["doc_id"], r["h"], r["text"]) for r in rows.withColumn("h", hashed).collect()), reverse=True)
    follows = {(a[0], a[2]): b[2] for a, b in zip(keyed, keyed[1:] + keyed[:1])}
    assert {(r["doc_id"], r["text"]): r["next_text"] for r in fingerprints.with_next(rows, "doc_id", ["text"]).collect()} == follows
