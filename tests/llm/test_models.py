"""Language ID, toxicity and the language model: held-out quality, exact counts, gradients, odd cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import grouping, language_id, language_model, pieces, toxicity
from ledgermill.llm.queries import op6_toxicity, op7_language_model, op10_language_id

from .conftest import prose


def crc(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_id_held_out(spark, sf_dir):
    rows = op10_language_id(spark, sf_dir).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_language_id_against_plain_naive_bayes(spark):
    texts = [("aab abb", "x"), ("bba", "y"), ("cc", "y"), ("ab", "x")]
    frame = spark.createDataFrame(texts, "text string, lang string")
    model = language_id.fit(frame)
    assert model.languages == ["x", "y"]
    counts = {k: Counter(b for t, l in texts if l == k for b in language_id.ngram_buckets(__import__("pyarrow").array([t]), language_id.BUCKETS)[0].tolist()) for k in "xy"}
    got = {r["text"]: r for r in language_id.predict(spark, frame, model).collect()}
    for t, _ in texts:
        at = language_id.ngram_buckets(__import__("pyarrow").array([t]), language_id.BUCKETS)[0].tolist()
        logs = [np.log(0.5) + sum(np.log((counts[k][b] + 0.5) / (sum(counts[k].values()) + 0.5 * language_id.BUCKETS)) for b in at) for k in "xy"]
        assert got[t]["lang_pred"] == "xy"[int(np.argmax(logs))]
        assert got[t]["score"] == pytest.approx(1 / (1 + np.exp(min(logs) - max(logs))), abs=1e-4)


def test_language_id_odd_cases(spark, docs, empty, texts):
    model = language_id.fit(docs)
    rows = language_id.predict(spark, docs, model)
    assert rows.columns == [*docs.columns, "lang_pred", "score"] and rows.count() == len(texts) + 1
    undetermined = {r["text"] for r in rows.collect() if r["lang_pred"] == "und"}
    assert undetermined == {None, "", " \n\n ", "!!! ???"}
    assert language_id.fit(empty).languages == []
    assert {r["lang_pred"] for r in language_id.predict(spark, docs, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.predict(spark, empty, model).count() == 0


def auc(scores, labels) -> float:
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    positive = np.asarray(labels) == 1
    return (ranks[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"  # the smaller tables hold out six toxic rows, too few to rank
    rows = op6_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, ordinary = ([s for s, k in held if k == c] for c in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in ordinary]) > 0.9


def test_toxicity_models_against_counting(spark, monkeypatch):
    """Discounts, excess and probabilities of models of up to two words against plain counting; each context's probabilities sum to one."""
    monkeypatch.setattr(toxicity, "ORDER", 2)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05], size=rng.integers(2, 9))) + (" bad c" if i % 3 == 0 else "") for i in range(300)]
    toxic = [int(i % 3 == 0) for i in range(300)]
    counts: dict = {}
    for t, k in zip(texts, toxic):
        words = ["<s>", *t.split()]
        for n, grams in ((1, {("", w) for w in words[1:]}), (2, set(zip(words, words[1:])))):
            for context, w in grams:
                counts.setdefault((n, context), {}).setdefault(w, [0, 0])[k] += 1
    n1, n2 = ({n: sum(sum(c) == j for (m, _), x in counts.items() if m == n for c in x.values()) for n in (1, 2)} for j in (1, 2))
    usual = {n: n1[n] / max(n1[n] + 2 * n2[n], 1) for n in (1, 2)}
    excess: dict = {}
    for (n, context), words in counts.items():
        every = [sum(c[k] for c in words.values()) for k in (0, 1)]
        for w, c in words.items():
            for k in (0, 1):
                e = sum(c) * every[k] / sum(every)
                beyond = c[k] - e - toxicity.DEVIATIONS * e**0.5 - usual[n]
                excess[n, context, w, k] = max(beyond, 0) / max(every[k], 1) if sum(c) > 1 else 0.0
    share = {w: sum(c) / sum(sum(x) for x in counts[1, ""].values()) for w, c in counts[1, ""].items()}

    def probability(k: int, context: str, w: str) -> float:
        p = share[w]
        for n, at in ((1, ""), (2, context)):
            p = excess.get((n, at, w, k), 0.0) + (1 - sum(excess.get((n, at, x, k), 0.0) for x in share)) * p
        return p

    frame = spark.createDataFrame([(t, k) for t, k in zip(texts, toxic)], "text string, toxic int")
    counted = grouping.map_arrow(frame, lambda b: toxicity._counted(b, 2), "n int, context long, key long, word long, ordinary long, toxic long")
    grams = counted.groupBy("n", "context", "key", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    words = grams.where("n = 1")
    total = words.selectExpr("sum(ordinary + toxic)").first()[0]
    found = toxicity.discounted(grams).join(words.selectExpr("word", f"(ordinary + toxic) / {total} as share"), "word").toPandas()
    model = toxicity.ToxicityModel(tuple(toxicity._table(found[found["n"] == n]) for n in (1, 2)), None)
    assert len(model.orders[0].keys) >= 1 and len(model.orders[1].keys) >= 1
    for context in share:
        sums = np.zeros(2)
        for w in share:
            expressions, _ = toxicity.expressions(pa.array([f"{context} {w}"]), 2)
            got = toxicity.relative_probabilities(model, expressions)[1] * share[w]
            assert got == pytest.approx([probability(0, context, w), probability(1, context, w)], rel=1e-6)
            sums += got
        assert sums == pytest.approx([1, 1], abs=1e-9)


def test_kneser_ney_against_plain_counting(spark, monkeypatch):
    """The model that the query uses: continuations of words, documents of pairs, usual discounts, back-off by class and history; each history's probabilities sum to one."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefgh"), p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05], size=rng.integers(2, 9))) + (f" bad r{i}" if i % 3 == 0 else "") for i in range(120)]
    toxic = [int(i % 3 == 0) for i in range(120)]
    rows = spark.createDataFrame([(t, k, 0) for t, k in zip(texts, toxic)], "text string, toxic int, part int")
    monkeypatch.setattr(toxicity, "training_rows", lambda *_: (rows, {0: 80, 1: 40}))
    model = toxicity.fit(rows, rows)
    pairs: dict = {}
    for t, k in zip(texts, toxic):
        for h, w in set(zip(["<s>", *t.split()], t.split())):
            pairs.setdefault(h, {}).setdefault(w, [0, 0])[k] += 1
    vocabulary = sorted({w for x in pairs.values() for w in x})
    assert model.words == len(vocabulary)

    def counts(history, which):
        of = lambda c: (sum(c), *c)[which]
        if history is not None:
            return {w: of(c) for w, c in pairs.get(history, {}).items() if of(c)}
        return {w: n for w in vocabulary if (n := sum(of(x[w]) > 0 for x in pairs.values() if w in x))}

    def discount(order, which):
        every = [n for h in (list(pairs) if order == 2 else [None]) for n in counts(h, which).values()]
        return max(every.count(1) / max(every.count(1) + 2 * every.count(2), 1), 1e-3)

    discounts = {(n, which): discount(n, which) for n in (1, 2) for which in (0, 1, 2)}

    def probability(which, history, w):
        p = 1 / (len(vocabulary) + 1)
        for order, h in ((1, None), (2, history)):
            for k in (0, which):
                c, d = counts(h, k), discounts[order, k]
                if c:
                    total = sum(c.values())
                    p = max(c.get(w, 0) - d, 0) / total + (1 - sum(max(n - d, 0) for n in c.values()) / total) * p
        return p

    for history in ("a", "h", "bad", "r3", "unseen"):
        sums = np.zeros(2)
        for w in [*vocabulary, "neverseen"]:
            got = toxicity.probabilities(model, toxicity.expressions(pa.array([f"{history} {w}"]))[0])[1]
            assert got == pytest.approx([probability(1, history, w), probability(2, history, w)], rel=1e-4)
            sums += got
        assert sums == pytest.approx([1, 1], abs=1e-4)


def test_toxic_pairs_of_ordinary_words_and_rare_words_tell(spark):
    """Word histories and words of few texts count: the classes have the same words, in other pairs, and one word in 2 of 40 toxic texts."""
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        words = prose(rng, 20).split()
        words[5:5] = ["green", "field"] if i % 2 else ["field", "green"]
        rows.append((i, " ".join(words)))
        marks.append((i, i % 2))
    rows += [(1000 + i, f"{prose(rng, 10)} {'seldom' if i < 2 else ''}") for i in range(40)]
    marks += [(1000 + i, 1) for i in range(40)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    said = toxicity.differences(model, pa.array(["the green field", "the field green"]))
    assert said[0] > said[1]
    rare = toxicity.differences(replace(model, weight=0.05), pa.array(["seldom", "ka"]))
    learned = any(crc(1000 + i, 5) != 0 for i in range(2))
    assert not learned or rare[0] >= rare[1]


@pytest.mark.parametrize("operator", ["toxicity", "language", "pieces"])
def test_columns_of_the_results_names_are_replaced(spark, operator):
    frame = spark.createDataFrame([(1, "some words of text", 9, "x", 7, "y")], "doc_id long, text string, score int, lang_pred string, ids int, round_trip string")
    if operator == "toxicity":
        out = toxicity.score(frame, None)
        assert out.columns == ["doc_id", "text", "lang_pred", "ids", "round_trip", "score"] and out.first()["score"] == 0.0
    elif operator == "language":
        out = language_id.predict(spark, frame, language_id.fit(frame.withColumn("lang", F.lit("en"))))
        assert out.columns == ["doc_id", "text", "ids", "round_trip", "lang_pred", "score"] and out.first()["lang_pred"] == "en"
    else:
        out = pieces.encode(frame, pieces.load(), check="round_trip")
        assert out.columns == ["doc_id", "text", "score", "lang_pred", "ids", "round_trip"] and out.first()["round_trip"] is True


def test_toxicity_planted_words_and_odd_cases(spark, docs, empty):
    rng = random.Random(9)
    bad = ["grukh", "vlort", "zhnak"]
    texts, toxic = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        for k in rng.sample(range(60), 8) if i % 4 == 0 else ():
            words[k] = rng.choice(bad)
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    held = [i for i in scored if crc(i, 5) == 0]
    assert np.mean([(scored[i] >= 0.5) == toxic[i] for i in held]) > 0.95
    assert toxicity.fit(frame, labels.where("toxic = 0")) is None
    assert toxicity.fit(empty.select("doc_id", "text"), labels) is None or toxicity.score(docs, None).count() == docs.count()
    odd = toxicity.score(docs, model)
    assert odd.columns == [*docs.columns, "score"] and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_language_model_counts_and_gain(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op7_language_model(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for i, t in texts.items()}
    held = {i for i in texts if crc(i, 5) == 1}
    counts = Counter(w for i, t in tokens.items() if i not in held for w in t)
    total, types = sum(counts.values()), len(counts)
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r["held_out"] == (i in held) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]))
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens[i]), rel=1e-9)
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


def test_language_model_words_beyond_the_table(spark, sf_dir):
    """With a table of 3000 words the rest are joined, and every figure is the same."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.expr("doc_id % 5 = 1"))
    whole, joined = ({r["doc_id"]: r for r in language_model.score(frame, table_words=n, rounds=1).collect()} for n in (1 << 20, 3000))
    for i, r in whole.items():
        assert tuple(joined[i])[:5] == tuple(r)[:5]
        assert joined[i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)
        assert joined[i]["score"] == pytest.approx(r["score"], rel=0.1)


def test_language_model_odd_cases(spark, docs, empty, texts):
    rows = language_model.score(docs.withColumn("held_out", F.expr("coalesce(doc_id % 5 = 1, true)"))).collect()
    assert len(rows) == len(texts) + 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] == texts.index(None)} == {1}
    nothing = language_model.score(docs.withColumn("held_out", F.lit(True))).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and {r["base_score"] for r in nothing} == {0.0}
    assert language_model.score(empty.withColumn("held_out", F.lit(False))).count() == 0


def small_table() -> language_model.Counts:
    top = np.sort(np.random.default_rng(2).integers(1, 5000, language_model.TOP))[::-1].astype(float)
    return language_model.Counts(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 10, 10, 5, np.full(language_model.BANDS, 10.0), top)


def test_language_model_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in language_model.initial(small_table()).items()}
    symbols = np.arange(language_model.TOP + language_model.BANDS)
    for _ in range(3):
        h = rng.normal(0, 1, (1, language_model.STATE)).astype(np.float32)
        log, _ = language_model.outputs(p, np.repeat(h, len(symbols), 0), symbols)
        assert np.exp(log.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_language_model_gradients():
    m, rng = language_model, np.random.default_rng(0)
    p = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in m.initial(small_table()).items()}
    symbols, targets = (rng.integers(0, m.TOP + m.BANDS, (6, 5)) for _ in range(2))
    fresh, state = rng.random((6, 5)) < 0.2, rng.normal(0, 0.1, (5, m.STATE)).astype(np.float32)

    def loss(q) -> float:
        states, _, _ = m.forward(q, symbols, state, fresh)
        return -m.outputs(q, states[1:].reshape(-1, m.STATE), targets.ravel())[0].sum(dtype=float)

    grads = {k: np.zeros_like(v) for k, v in p.items()}
    states, gates, news = m.forward(p, symbols, state, fresh)
    _, by = m.outputs(p, states[1:].reshape(-1, m.STATE), targets.ravel(), grads)
    m.backward(p, symbols, fresh, states, gates, news, by.reshape(states[1:].shape), grads)
    for k in p:
        for i in np.abs(grads[k]).ravel().argsort()[-3:]:
            sides = []
            for step in (1e-2, -1e-2):
                q = {name: v.copy() for name, v in p.items()}
                q[k].ravel()[i] += step
                sides.append(loss(q))
            assert grads[k].ravel()[i] == pytest.approx((sides[0] - sides[1]) / 2e-2, rel=0.03, abs=2e-3)


def test_language_model_state_is_carried_across_windows():
    m, rng = language_model, np.random.default_rng(4)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.initial(small_table()).items()}
    sizes = np.array([1, 500, 3, 90, 1, 64])
    symbols = rng.integers(0, m.TOP + m.BANDS, sizes.sum())
    got = m.log_probabilities(p, symbols, sizes)
    at = 0
    for n, one in zip(sizes, got):
        own = symbols[at : at + n]
        inputs = np.concatenate([[m.TOP + m.BANDS], own[:-1]])[:, None]
        states, _, _ = m.forward(p, inputs, np.zeros((1, m.STATE), np.float32), np.arange(n)[:, None] == 0)
        assert one == pytest.approx(m.outputs(p, states[1:, 0], own)[0].sum(dtype=float) / np.log(10), rel=1e-3)
        at += n
