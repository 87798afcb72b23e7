"""Near-duplicates, lines, paragraphs and repeated strings against brute force, with the odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ledgermill.llm import edits, grouping, line_dedup, paragraph_dedup, suffix_dedup, weighted_minhash
from ledgermill.llm import textarrays as ta

from .conftest import prose

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal(text: str | None) -> tuple[bytes, ...]:
    return tuple(WORD.findall((text or "").lower().encode()))


def shingles(words: tuple[bytes, ...]) -> Counter:
    return Counter(words[i : i + 5] for i in range(max(1, len(words) - 4))) if words else Counter()


def groups_of(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(60)]
    texts = [*base, *(t + " tail of a copy" for t in base[:20]), *(" ".join(t.split()[:60] + prose(rng, 60).split()) for t in base[20:30]), *base[:3], base[0].upper() + "!"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in weighted_minhash.near_duplicates(frame).collect()}
    sets = [shingles(normal(t)) for t in texts]
    idf = weighted_minhash.inverse_frequencies(frame.select("text"))
    assert idf.min() >= 1.0 and idf.max() <= 1.25 + 1e-6
    clear, unlike = [], 0
    for a in range(len(texts)):
        for b in range(a):
            both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if both / either > 0.9:
                clear.append((a, b))
            unlike += both / either > 0.7
    assert unlike == len(clear)  # nothing lies near the threshold, so the weights don't matter
    root = groups_of(len(texts), clear)
    sizes = Counter(root)
    assert got == {i: (root[i], sizes[root[i]]) for i in range(len(texts))}


def test_near_duplicates_odd_cases(docs, empty, texts):
    rows = weighted_minhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    wordless = {r["class_size"] for r in rows if r["doc_id"] in {i for i, t in enumerate(texts) if not normal(t)}}
    assert wordless == {sum(not normal(t) for t in texts)}
    kept = weighted_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["class_node"] for r in rows})
    assert weighted_minhash.near_duplicates(empty).count() == 0 == weighted_minhash.keep_one(empty).count()


def test_samples_collide_as_often_as_weighted_jaccard(monkeypatch):
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    weights = rng.random(400) * 3 + 0.1
    other = weights * np.where(rng.random(400) < 0.5, 1.0, 0.6)
    expected = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    hits = []
    for _ in range(40):
        own = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
        first = np.array([0, 400])
        hits.append((weighted_minhash.samples(own, weights, first) == weighted_minhash.samples(own, other, first)).mean())
    assert abs(np.mean(hits) - expected**weighted_minhash.ROWS) < 0.08


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distances_against_the_plain_table():
    rng = random.Random(1)
    left, right = [], []
    for _ in range(400):
        a = "".join(rng.choice("abcdé 漢") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 128, 130, 600])))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 4))):
            at, n = rng.randint(0, len(b)), rng.randint(0, 1)
            b[at : at + n] = rng.choice(["", "a", "x"])
        left.append(a)
        right.append("".join(b) if rng.random() < 0.9 else "".join(rng.choice("abcdé 漢") for _ in range(rng.randint(0, 150))))
    wanted = np.array([distance(a, b) for a, b in zip(left, right)])
    assert edits.distances(left, right).tolist() == wanted.tolist()
    for share in (0.0, 0.05, 0.1, 0.3):
        most = np.array([int(share * max(len(a), len(b))) for a, b in zip(left, right)])
        assert edits.within(left, right, most).tolist() == (wanted <= most).tolist()


def edited(rng: random.Random, line: str) -> str:
    """A line with a letter changed, a word replaced, or a word put in or taken out, at random places."""
    words = line.split()
    at = rng.randrange(len(words))
    kind = rng.randrange(4)
    if kind == 0:
        i = rng.randrange(len(words[at]))
        words[at] = words[at][:i] + "q" + words[at][i + 1 :]
    elif kind == 1:
        words[at] = rng.choice(["zu", "zuva", "zuvaxo"])
    elif kind == 2:
        words.insert(at, "zu")
    else:
        del words[at]
    return " ".join(words)


@pytest.mark.parametrize("sizes, times", [((4, 14), 1), ((12, 40), 1), ((30, 90), 3)])
def test_lines_against_all_pairs(spark, sizes, times):
    """Lines with edits at random places: no pair is taken that isn't alike, and nine of ten groups of all pairs that are alike are found."""
    rng = random.Random(4)
    lines = [prose(rng, rng.randint(*sizes)) for _ in range(60)]
    copies = []
    for x in lines[:45]:
        for _ in range(times):
            x = edited(rng, x)
        copies.append(x)
    pool = [*lines, *copies, *(x.upper() + "." for x in lines[45:50]), "short line", "short line"]
    rng.shuffle(pool)
    texts = ["\n".join(pool[i : i + 4]) for i in range(0, len(pool), 4)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(frame).collect()}
    placed = [(i, j, b" ".join(normal(y)).decode()) for i, t in enumerate(texts) for j, y in enumerate(t.split("\n"))]
    placed = [x for x in placed if len(x[2]) >= line_dedup.MIN_CHARS]
    alike = lambda a, b: distance(placed[a][2], placed[b][2]) <= (1 - line_dedup.SIMILARITY) * max(len(placed[a][2]), len(placed[b][2])) + 1e-9
    root = groups_of(len(placed), [(a, b) for a in range(len(placed)) for b in range(a) if alike(a, b)])
    wanted = {placed[i][:2] for i in range(len(placed)) if root[i] != i}
    assert len(wanted) > 20 and got <= wanted and len(got) >= 0.9 * len(wanted)


def test_lines_with_one_letter_changed(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(200):
        line = prose(rng, 12)
        i = rng.choice([k for k, c in enumerate(line) if c != " "])
        texts += [line, line[:i] + "q" + line[i + 1 :]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.repeated_lines(frame).collect()} == set(range(1, 400, 2))


@pytest.mark.parametrize("words, edits_", [(8, 2), (12, 2), (24, 4), (50, 8)])
def test_lines_with_letters_changed_in_several_words(spark, words, edits_):
    """Letters changed in different words: nine of ten such pairs, all of edit similarity 0.9, are found."""
    rng = random.Random(11)
    texts = []
    for _ in range(100):
        line = [rng.choice("bdfgklmnprst") + "".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 8))) for _ in range(words)]
        changed = list(line)
        for at in rng.sample(range(words), edits_):
            i = rng.randrange(len(line[at]))
            changed[at] = line[at][:i] + "q" + line[at][i + 1 :]
        a, b = " ".join(line), " ".join(changed)
        assert distance(a, b) <= (1 - line_dedup.SIMILARITY) * len(a)
        texts += [a, b]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in line_dedup.repeated_lines(frame).collect()}
    assert got <= set(range(1, 200, 2)) and len(got) >= 90


@pytest.mark.parametrize("tile", [4096, 16])
def test_lines_of_a_large_block_make_no_rows_of_pairs(spark, monkeypatch, tile):
    """Lines with one half in common, in groups of near copies, some just too far apart: links are fewer than lines, and groups are those of all pairs."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(6)
    common, lines = prose(rng, 12), []
    for _ in range(12):
        own = f"{common} {prose(rng, 14)}"
        for _ in range(8):
            changed = own.split()
            for at in rng.sample(range(12, 26), rng.randint(0, 3)):
                changed[at] = rng.choice(["zu", "zuva", "zuvaxo"])
            lines.append(" ".join(changed))
    lines = sorted(set(lines))
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    numbered = line_dedup.numbered_lines(frame, "text", "doc_id")
    signed = numbered.mapInArrow(line_dedup._signed, "doc_id long, text_hash long, line int, node binary, blocks array<bigint>")
    of = {r["node"]: r["doc_id"] for r in signed.collect()}
    found = [(of[r["a"]], of[r["b"]]) for r in line_dedup.linked_lines(numbered, signed.where("size(blocks) > 0").select("node", "blocks"), 0.9).collect()]
    n = len(lines)
    alike = {(a, b) for a in range(n) for b in range(a) if edits.distance(lines[a], lines[b]) <= int(0.1 * max(len(lines[a]), len(lines[b])) + 1e-9)}
    assert {tuple(sorted(x, reverse=True)) for x in found} <= alike and groups_of(n, found) == groups_of(n, alike)
    assert len(found) < n * (1 if tile > n else 8) and len(alike) > n


def test_profiles_bound_distances_and_reach_keeps_small_ones(monkeypatch):
    monkeypatch.setattr(edits, "FEW", 1)
    rng = random.Random(9)
    left = [prose(rng, rng.randint(3, 120)) for _ in range(400)]
    right = [" ".join("qqq" + w if rng.random() < p else w for w in x.split()) for x, p in zip(left, np.linspace(0, 0.8, 400))]
    exact = np.array([edits.distance(a, b) for a, b in zip(left, right)])
    for q, width in line_dedup.PROFILES:
        both = edits.profiles(left + right, q, width)
        assert (edits.least_distances(both, np.arange(400), np.arange(400, 800), q) <= exact).all()
    most = np.array([len(x) // 10 for x in right])
    got = edits.distances(left, right, most)
    assert (got >= exact).all() and (got[exact <= most] == exact[exact <= most]).all() and (exact > most).sum() > 50 < (exact <= most).sum()


def test_lines_that_repeat_one_word_do_not_meet(spark):
    """A word that has most of a run doesn't make blocks of lines that share nothing else."""
    rows, hashes, first, _ = line_dedup._normal(pa.array([f"{x} die die die die {y} die die die die {z} {x}{y} {y}{z} {z}{x}" for x, y, z in (("alpha", "beta", "gamma"), ("one", "two", "three"))]))
    line, key = line_dedup.line_blocks(hashes, first)
    shared = set(key[line == 0].tolist()) & set(key[line == 1].tolist())
    assert len(rows) == 2 and len(shared) == 0


def test_long_lines_have_all_their_runs_as_blocks():
    rng = random.Random(8)
    text = [prose(rng, n) for n in (13, 20, 21, 60, 400)]
    text.append(" ".join([*text[3].split()[20:25], *prose(rng, 70).split()]))  # one run in common with the fourth
    _, hashes, first, _ = line_dedup._normal(pa.array(text))
    line, key = line_dedup.line_blocks(hashes, first)
    assert np.bincount(line).tolist() == [len(x.split()) - 4 for x in text]
    assert set(key[line == 3].tolist()) & set(key[line == 5].tolist())


def test_packed_keys_give_the_blocks_of_several_nodes(monkeypatch):
    monkeypatch.setattr(line_dedup, "PACKED", 300)
    rng = np.random.default_rng(4)
    high, low = rng.integers(0, 1 << 63, (2, 60)).astype(np.uint64)
    keys = [(rng.integers(0, 150, rng.integers(0, 30)).astype(np.uint64) << np.uint64(55)) | np.uint64(1 << 30) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([grouping.node_ids(high[i : i + 7], low[i : i + 7]), pa.array([k.view(np.int64).tolist() for k in keys[i : i + 7]], pa.list_(pa.int64()))], ["node", "blocks"]) for i in range(0, 60, 7)]
    for bits in (1, 6):
        rows = sorted((r for b in line_dedup._packed(bits)(iter(batches)) for r in b.to_pylist()), key=lambda r: r["segment"])
        held = [pa.RecordBatch.from_pylist(rows[i : i + 3], pa.schema([("segment", pa.int32()), ("steps", pa.binary()), ("tags", pa.binary())])) for i in range(0, len(rows), 3)]
        got = {}
        for r in (r for b in line_dedup._blocks_of_several(iter(held)) for r in b.to_pylist()):
            got.setdefault((r["members"], r["least"], r["size"]), set()).add(r["tag"])
        want = {}
        for tag, own in zip(line_dedup._tags(high).tolist(), keys):
            for k in own.tolist():
                want.setdefault(k, set()).add(tag)
        want = {frozenset(x) for x in want.values() if len(x) > 1}
        assert {frozenset(x) for x in got.values()} == want and all(len(x) == n and min(x) == least for (_, least, n), x in got.items())


def test_lines_odd_cases(docs, empty, texts):
    done = line_dedup.drop_repeated_lines(docs, counts=("n_lines", "n_removed"))
    assert done.columns == [*docs.columns, "n_lines", "n_removed"]
    assert done.count() == len(texts) + 1
    rows = {r["doc_id"]: r for r in done.collect()}
    assert rows[texts.index(None)]["text"] is None
    assert rows[texts.index(" \n\n ")]["text"] == " \n\n "
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def plain_paragraphs(text: str | None) -> list[tuple[bytes, ...]]:
    """Cut word by word: before a word whose hash, with the next one's, is the least of the 6 words on both sides (the first of equal ones)."""
    words = normal(text)
    hashes, _, _, _ = ta.words(*ta.packed(pa.array([text or ""]), "utf8"))
    after = [*(ta.mix(hashes[1:] * paragraph_dedup._NEXT)), np.uint64(0)] if len(hashes) else []
    value = [int(ta.mix(np.array([a ^ b]))[0]) for a, b in zip(hashes, after)]
    at, reach = [0], paragraph_dedup.REACH
    for i in range(reach + 1, len(words) - reach):
        if all(value[i] < x for x in value[i - reach : i]) and all(value[i] <= x for x in value[i + 1 : i + reach + 1]):
            at.append(i)
    return [words[i:j] for i, j in zip(at, [*at[1:], len(words)])] if words else []


def test_paragraphs_against_all_pairs(spark, docs, empty):
    """A passage inside long lines, wrapped, in capitals, and with an edit; groups are those of all pairs of paragraphs with a Jaccard similarity of 0.8."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    near = passage.split()
    near[30] = "qqq"
    texts = [f"{prose(rng, 40)} {passage} {prose(rng, 40)}", f"{prose(rng, 41)}\n{passage.upper()}\n{prose(rng, 30)}", passage.replace(" ", "\n"), f"{' '.join(near)} {prose(rng, 9)}", prose(rng, 80), "few words only", "Few words, only!", None, "", "!!!"]
    texts += [prose(rng, 30) + " " + " ".join(near[:40]) for _ in range(20)]  # a block that is large
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["paragraph"]): r for r in paragraph_dedup.duplicate_paragraphs(frame).collect()}
    placed = [(i, j, p) for i, t in enumerate(texts) for j, p in enumerate(plain_paragraphs(t))]
    sets = [set(shingles(p)) for *_, p in placed]
    root = groups_of(len(placed), [(a, b) for a in range(len(placed)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    sizes = Counter(root)
    wanted = {placed[i][:2]: (sizes[r], placed[r][:2], len(placed[i][2])) for i, r in enumerate(root) if sizes[r] > 1}
    assert {0, 1, 2, 3, 5, 6} <= {i for i, _ in wanted} and not {4, 7, 8, 9} & {i for i, _ in wanted}
    assert {k: (r["n_occurrences"], (r["group_id"], r["group_paragraph"]), r["n_words"]) for k, r in got.items()} == wanted
    assert all(r["kept"] == (k == wanted[k][1]) for k, r in got.items())
    assert paragraph_dedup.duplicate_paragraphs(empty).count() == 0


def test_paragraphs_odd_cases(spark, docs, texts):
    """Null ids and repeated rows are occurrences, and one of a group's is kept; wordless texts have none; very long ones are whole."""
    rows = paragraph_dedup.duplicate_paragraphs(docs).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r["group_id"], r["group_paragraph"]), []).append(r)
    assert all(len(g) == g[0]["n_occurrences"] for g in groups.values())
    # The first row stands there twice, so both of its occurrences are the kept one's equals.
    assert all(sum(r["kept"] for r in g) == (2 if k[0] == 0 else 1) for k, g in groups.items())
    assert any(r["doc_id"] is None for r in rows)  # its copy's paragraphs
    assert not {r["doc_id"] for r in rows} & {texts.index(None), texts.index(""), texts.index("!!! ???")}
    rng = random.Random(2)
    long = prose(rng, 40000)
    frame = spark.createDataFrame([(1, long, 1), (2, f"x {long}", 2)], "doc_id long, text string, paragraph int")
    found = paragraph_dedup.duplicate_paragraphs(frame).groupBy("doc_id").agg({"n_words": "sum"}).collect()
    assert {r["doc_id"] for r in found} == {1, 2} and all(r["sum(n_words)"] > 39900 for r in found)


@pytest.mark.parametrize("shape", [(9, 4), (40, 1), (3000, 3)])
def test_links_of_a_block_larger_than_one_task_compares(spark, shape):
    """All members of a block that are alike are found, whatever its size; nodes are alike if they agree in their last value."""
    n, kinds = shape
    nodes = spark.range(n).selectExpr("id as node", "1.0 as total", f"array(-1L, id % {kinds}, -id - 2) as blocks", f"id % {kinds} as kind")
    texts = nodes.select("node", "kind")

    def verify(pairs, contents):
        a, b = (contents.selectExpr(f"node as {x}", f"kind as {x}_kind") for x in "ab")
        return pairs.join(a, "a").join(b, "b").where("a_kind = b_kind")

    found = grouping.links(nodes.select("node", "total", "blocks"), 0.8, lambda chosen: texts.join(chosen, "node"), verify)
    roots = grouping.connected(found)
    sizes = sorted(r["count"] for r in roots.groupBy("root").count().collect())
    assert sizes == sorted(Counter(i % kinds for i in range(n)).values())


@pytest.mark.parametrize("alike", ["a % 20 = b % 20", "abs(a - b) <= 1"])
def test_links_of_a_large_block_that_agrees_in_one_band_only(spark, alike):
    """Nodes of a block of 60 share no other band; in the second case most nodes are alike to few of the block, and not to its leader."""
    nodes = spark.range(60).selectExpr("id as node", "1.0 as total", "array(-1L, id, id, id, id, id) as blocks")
    found = grouping.links(nodes, 0.8, lambda chosen: nodes.join(chosen, "node"), lambda pairs, contents: pairs.where(alike))
    sizes = sorted(r["count"] for r in grouping.connected(found).groupBy("root").count().collect())
    assert sizes == ([3] * 20 if "%" in alike else [60])


def test_rarest_elements_lose_no_alike_pair(spark):
    """Sets around a common core, with weights: each pair that shares 0.8 of both weights has a common block and may be alike by it."""
    rng = random.Random(3)
    core = list(range(30))
    weight = {g: rng.choice([1.0, 1.2, 3.0]) for g in range(2000)}
    sets = [{*rng.sample(core, rng.randint(15, 30)), *(rng.randint(30, 400) for _ in range(rng.randint(0, 8)))} for _ in range(80)]
    grams = spark.createDataFrame([(i, g, weight[g]) for i, x in enumerate(sets) for g in x], "node long, gram long, weight float")
    rows = grouping.rarest_blocks(grams, 0.8).collect()
    of: dict = {}
    for r in rows:
        of.setdefault(r["node"], {})[r["block"]] = (r["total"], r["rest"])
    w = lambda x: sum(weight[g] for g in x)
    alike = 0
    for a in range(len(sets)):
        for b in range(a):
            if w(sets[a] & sets[b]) >= 0.8 * w(sets[a] | sets[b]):
                alike += 1
                assert any((s := min(of[a][g][1], of[b][g][1])) >= 0.8 * (of[a][g][0] + of[b][g][0] - s) - 1e-3 for g in of[a].keys() & of[b].keys())
    assert alike > 20 and len(rows) < 0.6 * sum(map(len, sets))


def test_hubs_are_joined_where_they_are(spark):
    rows = spark.range(5000).selectExpr("if(id < 3000, 0L, id) as u", "id as v")
    few = rows.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    assert grouping.join_few(rows, few, "u", "n", 5000).where("least = v").count() == 2001


def test_connected_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(500, 510).selectExpr("id as a", "500L as b"))
    roots = {r["node"]: r["root"] for r in grouping.connected(edges).collect()}
    assert roots == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 510)}}


def brute_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1]))
        out.append((len(d), sum(mark), spans, hashlib.sha256(bytes(x for x, y in zip(d, mark) if not y)).hexdigest()))
    return out


def test_repeated_starts_against_counting():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([1, 2, 3, 5, 9, 20])
        parts = [bytes(rng.choice(b"ab\x00\xffc"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
        counts = Counter(s[i : i + length] for s in parts for i in range(len(s) - length + 1))
        wanted = [x for s in parts for x in [*(i + length <= len(s) and counts[s[i : i + length]] > 1 for i in range(len(s))), False]]
        assert suffix_dedup.repeated_starts(parts, length).tolist() == wanted


@pytest.mark.parametrize("length, anchor, hot, alphabet", [(20, 8, 4, "ab"), (24, 7, 5, "abcdé"), (200, 40, 3, "abcdef "), (200, 40, 2048, "abc")])
def test_repeats_against_brute_force(spark, length, anchor, hot, alphabet):
    rng = random.Random(5)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 3 * length))) for _ in range(12)]
    texts: list[str | None] = []
    for _ in range(120):
        texts.append("".join(rng.choice(pool) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 2 * length))) for _ in range(rng.randint(0, 4))))
    texts += [None, "", "x" * 1000, "ab" * 200, "q" * (length + 1), "zyx" * (length // 3 + 3), *texts[:3]]
    frame = spark.createDataFrame([(None if i == 5 else i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, k1 string").repartition(4)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame, length=length, anchor=anchor, hot=hot, digest=True).collect()}
    assert got == {None if i == 5 else i: x for i, x in enumerate(brute_repeats(texts, length))}


def test_repeats_odd_cases(docs, empty, texts):
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r["n_removed"] for r in rows if r["doc_id"] == 0} == {len(texts[0].encode())}  # the row is there twice
    assert suffix_dedup.remove_repeats(empty).count() == 0
