"""BPE by the trie against the tokenizers library, over texts, odd characters and odd tables."""

from __future__ import annotations

import hashlib
import random

import pytest
import tokenizers
from pyspark.sql import functions as F

from ledgermill.llm import bpe
from ledgermill.llm.queries import op11_bpe

ODD = [
    "", "  \n", "<|endoftext|>", "a<|startoftext|>É<|endoftext|> b", "the<|endoftext", "ΑΣ ΣΑΣ ς", "İstanbul ǅ é́ é", "it's we'll 'S 's", "x" * 5000, "aaaa" * 777 + "!", "123 ½ ४५", "漢字 かな",
    "\x1c\x1d a\x85b​", "՘a Ƛb \U00016ea0c \U0003d000", "\U0001f600\U0001f600 x",
]


@pytest.fixture(scope="module")
def merges():
    return bpe.load()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.path())
    t.no_truncation()
    t.no_padding()
    return t


def encoded(encoder, merges, texts):
    ids, counts = encoder.encode(texts)
    ends = counts.cumsum()
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)], bpe.decode_ids(ids, counts, merges)


def test_equals_the_library(merges, library):
    rng = random.Random(3)
    parts = ["th", "in", "er", "an", "ing", "s", "tt", "oo", "aaa", "re", "ly"]
    texts = ["".join(rng.choice("abcdeéstrinog' !1\n") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice((rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x20000)))) for _ in range(40)) for _ in range(200)]
    encoder = bpe.Encoder(merges)
    for chunk in (ODD, texts[:7], texts, ODD[::-1]):  # words met before come again
        want = [x.ids for x in library.encode_batch(chunk, add_special_tokens=False)]
        got, back = encoded(encoder, merges, chunk)
        assert got == want
        assert back == [library.decode(x, skip_special_tokens=False) for x in want]


def test_a_new_trie_changes_nothing(merges, monkeypatch):
    texts = ["some words", "some worlds are larger", "words", "some words"]
    want = encoded(bpe.Encoder(merges), merges, texts)
    monkeypatch.setattr(bpe, "MAX_NODES", 5)
    encoder = bpe.Encoder(merges)
    got = [encoded(encoder, merges, [t]) for t in texts]
    assert ([g[0][0] for g in got], [g[1][0] for g in got]) == want


def test_every_whole_token_encodes_to_itself(merges, library):
    """Pairs stand side by side as plain merging of their symbols leaves them."""
    rng = random.Random(4)
    pieces = [t for s, t in merges.spelled.items() if ord(s[-1]) < bpe.LAST]
    spell = {t: s for s, t in merges.spelled.items()}
    for _ in range(2000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        ids = [merges.spelled[c] for c in spell[a] + spell[b]]
        while True:
            ranked = [(merges.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges.pairs]
            if not ranked:
                break
            _, i = min(ranked)
            ids[i : i + 2] = [next(z for z in (merges.spelled.get(spell[ids[i]] + spell[ids[i + 1]]),) if z is not None)]
        assert merges.side_by_side(a, b) == (ids == [a, b])


def test_frames_keep_rows_and_columns(spark, docs, texts, merges, library):
    frame = docs.withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(frame, merges), merges).collect()
    assert len(rows) == len(texts) + 1
    assert set(frame.columns) | {"decoded"} == set(rows[0].asDict())
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is None and r["decoded"] is None
        else:
            assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids
            assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)


def test_empty_table(spark, empty, merges):
    assert bpe.decode(bpe.encode(empty, merges), merges).collect() == []


def test_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = op11_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
