"""Benchmark decontamination by greedy string tiling: shared-token seeds, Karp-Rabin tiles, and a threshold on each item's coverage.

Seeds are the hashes of every run of `MIN_MATCH` tokens. A document and a benchmark item that share a seed are tiled: the longest
run of tokens that both still have unmarked is found by Karp-Rabin window hashes, marked in both, and so on down to `MIN_MATCH`. A tile
may lie anywhere, so an item whose sentences come in another order is covered all the same. A document is contaminated by an item if
its tiles cover `COVERAGE` of the item's tokens; an item of fewer tokens than `MIN_MATCH` must occur whole.

The benchmark side is broadcast while its texts have no more than `MAX_BROADCAST_BYTES`; a larger benchmark is joined by shuffled
seeds instead, one row for each distinct seed of a document, and gives the same rows.

Defined cases: null, empty and wordless texts match nothing; items without a word are skipped; repeated documents and items, and null ids,
give a row each; ties between tiles go to the first in the item, then in the document. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import grouping
from . import textarrays as ta

MIN_MATCH, COVERAGE = 5, 0.6
MAX_BROADCAST_BYTES = 32 << 20


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of so many tokens."""
    if len(tokens) < size:
        return np.zeros(0, np.uint64)
    up, down = ta.powers(len(tokens) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * up[:-1], dtype=np.uint64)])
    return ta.mix((sums[size:] - sums[:-size]) * down[: len(tokens) - size + 1])


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Whether each window has no marked token."""
    if len(marked) < size:
        return np.zeros(0, bool)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[size:] == sums[:-size]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays: (start in item, start in doc, length), longest first, none overlapping."""
    found: list[tuple[int, int, int]] = []
    item_marked, doc_marked = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def common(size: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = window_hashes(item, size), window_hashes(doc, size)
        at_a, at_b = np.flatnonzero(_free(item_marked, size)), np.flatnonzero(_free(doc_marked, size))
        b_sorted = at_b[np.argsort(b[at_b], kind="stable")]
        at = np.searchsorted(b[b_sorted], a[at_a])
        hit = at < len(b_sorted)
        hit[hit] = b[b_sorted[at[hit]]] == a[at_a[hit]]
        return at_a[hit], b_sorted

    most = min(len(item), len(doc))
    while most >= least:
        low, high = least - 1, most
        while low < high:  # a common free run of some length has one of every lesser length
            size = (low + high + 1) // 2
            low, high = (size, high) if len(common(size)[0]) else (low, size - 1)
        if low < least:
            break
        starts, b_sorted = common(low)
        b = window_hashes(doc, low)
        a = window_hashes(item, low)
        for i in starts.tolist():
            if item_marked[i : i + low].any():
                continue
            left, right = np.searchsorted(b[b_sorted], a[i], "left"), np.searchsorted(b[b_sorted], a[i], "right")
            for j in b_sorted[left:right].tolist():
                if not doc_marked[j : j + low].any():
                    item_marked[i : i + low] = doc_marked[j : j + low] = True
                    found.append((i, j, low))
                    break
        most = low - 1 if not len(common(low)[0]) else low
    return found


class Seeds:
    """The benchmark: each item's tokens and, for every seed, the items that have it."""

    def __init__(self, texts: list[str | None], least: int) -> None:
        hashes, _, _, first = ta.words(*ta.packed(pa.array(texts, pa.string()), "utf8"))
        self.tokens = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        self.least = [min(least, len(x)) for x in self.tokens]
        seeds, owners, sizes = [], [], []
        for i, tokens in enumerate(self.tokens):
            if len(tokens):
                own = np.unique(window_hashes(tokens, self.least[i]))
                seeds.append(own)
                owners.append(np.full(len(own), i))
                sizes.append(np.full(len(own), self.least[i]))
        joined = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        seed, owner, size = joined(seeds, np.uint64), joined(owners, np.int64), joined(sizes, np.int64)
        #: Sorted seeds with their items, by seed length: shorter ones are whole items.
        self.by_size = {}
        for n in sorted(set(size.tolist())):
            order = np.argsort(seed[size == n], kind="stable")
            self.by_size[n] = (seed[size == n][order], owner[size == n][order])


def compact(tokens: np.ndarray, at: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's tokens around its seeds (`reach` to either side), parted by marks that match nothing, and their places.

    A run that both sides share has a seed at each of its windows, so no tile is lost.
    """
    keep = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(keep, np.maximum(at - reach, 0), 1)
    np.add.at(keep, np.minimum(at + size + reach, len(tokens)), -1)
    inside = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(inside) > 1) + 1
    marks = ta.mix(np.arange(len(gaps), dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return np.insert(tokens[inside], gaps, marks), np.insert(inside, gaps, -1)


def coverages(seeds: Seeds, doc: np.ndarray) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """Of each item that shares a seed with the document: (item, tokens covered, coverage, tiles in document tokens)."""
    hits: dict[int, list[np.ndarray]] = {}
    for size, (seed, owner) in seeds.by_size.items():
        windows = window_hashes(doc, size)
        left, right = np.searchsorted(seed, windows, "left"), np.searchsorted(seed, windows, "right")
        at = np.flatnonzero(right > left)
        if len(at):
            n = right[at] - left[at]
            places = np.repeat(at, n)
            owners = owner[np.repeat(left[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            order = np.argsort(owners, kind="stable")
            cuts = np.flatnonzero(np.diff(owners[order])) + 1
            for own, where in zip(np.split(owners[order], cuts), np.split(places[order], cuts)):
                hits.setdefault(int(own[0]), []).append(where)
    out = []
    for i, where in sorted(hits.items()):
        item, least = seeds.tokens[i], seeds.least[i]
        near, places = compact(doc, np.concatenate(where), least, 0)
        found = tiles(item, near, least)
        covered = sum(n for _, _, n in found)
        out.append((i, covered, covered / len(item), [(a, int(places[b]), n) for a, b, n in found]))
    return out


_SCHEMA = "coverage double, n_tokens int, n_covered int, tiles array<struct<item_at:int,doc_at:int,n:int>>"
_TILE = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("n", pa.int32())]))


def contaminations(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row for each document and item whose coverage reaches the threshold: doc_id, item_id, coverage, n_tokens, n_covered, tiles."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    types = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    if size > max_broadcast_bytes:
        return _by_join(docs, items, types, least, coverage)
    rows = items.collect()  # no more than max_broadcast_bytes
    # Tasks name items by their number, so ids may be of any type.
    names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], StructType([StructField("item", IntegerType()), StructField("item_id", items.schema["item_id"].dataType)]))
    shared = docs.sparkSession.sparkContext.broadcast(Seeds([r["item_text"] for r in rows], least))

    def tiled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in ta.chunks(batch):
            hashes, _, _, first = ta.words(*ta.packed(part.column(1), "utf8"))
            found = [(row, *x) for row in _seeded(own, hashes, first) for x in coverages(own, hashes[first[row] : first[row + 1]]) if x[2] >= coverage]
            taken = part.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            yield _rows(taken, pa.array([x[1] for x in found], pa.int32()), [len(own.tokens[x[1]]) for x in found], [x[2:] for x in found])

    found = grouping.map_arrow(docs, tiled, f"doc_id {types[0]}, item int, {_SCHEMA}")
    return found.join(F.broadcast(names), "item").select("doc_id", "item_id", *found.columns[2:])


def _seeded(seeds: Seeds, hashes: np.ndarray, first: np.ndarray) -> list[int]:
    """The rows of a chunk that have a seed at all, found for the whole chunk at once."""
    rows: set[int] = set()
    for size, (seed, _) in seeds.by_size.items():
        windows = window_hashes(hashes, size)
        at = np.searchsorted(seed, windows)
        at[at == len(seed)] = 0
        hit = np.flatnonzero(seed[at] == windows)
        row = np.searchsorted(first, hit, "right") - 1
        rows.update(row[hit + size <= first[row + 1]].tolist())
    return sorted(rows)


def _rows(doc_ids: pa.Array, item_ids: pa.Array, n_tokens: list[int], found: list) -> pa.RecordBatch:
    tile_rows = [[{"item_at": a, "doc_at": b, "n": n} for a, b, n in x[2]] for x in found]
    arrays = [doc_ids, item_ids, pa.array([x[1] for x in found], pa.float64()), pa.array(n_tokens, pa.int32()), pa.array([x[0] for x in found], pa.int32()), pa.array(tile_rows, _TILE)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "coverage", "n_tokens", "n_covered", "tiles"])


def _by_join(docs: DataFrame, items: DataFrame, types: tuple[str, str], least: int, coverage: float) -> DataFrame:
    """The same rows for a benchmark too large to broadcast: seeds meet in a shuffled join, then texts do."""

    def seeds_of(batch: pa.RecordBatch, lengths: list[int] | None) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, batch.schema.names[-1]):
            hashes, _, _, first = ta.words(*ta.packed(part.column(part.num_columns - 1), "utf8"))
            row, seed = [], []
            for i in range(part.num_rows):
                tokens = hashes[first[i] : first[i + 1]]
                sizes = [min(least, len(tokens))] if lengths is None else [x for x in lengths if x <= len(tokens)]
                for size in sizes:
                    own = np.unique(window_hashes(tokens, size)) if len(tokens) else np.zeros(0, np.uint64)
                    row.append(np.full(len(own), i))
                    seed.append(own)
            row, seed = np.concatenate([np.zeros(0, np.int64), *row]), np.concatenate([np.zeros(0, np.uint64), *seed])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(seed.view(np.int64))], ["row_key", "seed"])

    docs = grouping.cut(docs.withColumn("row_key", F.xxhash64("doc_id", "text")))
    items = grouping.cut(items.withColumn("row_key", F.xxhash64("item_id", "item_text")))

    def lengths_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, "item_text"):
            _, _, _, first = ta.words(*ta.packed(part.column(1), "utf8"))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(np.diff(first), least)).astype(np.int32))], ["size"])

    lengths = sorted(r["size"] for r in grouping.map_arrow(items.select("row_key", "item_text"), lengths_of, "size int").distinct().collect() if r["size"])  # no more than `least`
    doc_seeds = grouping.map_arrow(docs.select("row_key", "text"), lambda b: seeds_of(b, lengths), "row_key long, seed long")
    item_seeds = grouping.cut(grouping.map_arrow(items.select("row_key", "item_text"), lambda b: seeds_of(b, None), "row_key long, seed long"))
    pairs = doc_seeds.withColumnRenamed("row_key", "doc_key").join(item_seeds.withColumnRenamed("row_key", "item_key"), "seed").select("doc_key", "item_key").distinct()
    joined = pairs.join(docs.withColumnRenamed("row_key", "doc_key"), "doc_key").join(items.withColumnRenamed("row_key", "item_key"), "item_key")

    def tiled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch):
            hashes, _, _, first = ta.words(*ta.packed(part.column(1), "utf8"))
            own = Seeds(part.column(3).to_pylist(), least)
            found = []
            for row in range(part.num_rows):
                one = Seeds([part.column(3)[row].as_py()], least)
                found += [(row, *x[1:]) for x in coverages(one, hashes[first[row] : first[row + 1]]) if x[2] >= coverage]
            at = pa.array([x[0] for x in found], pa.int64())
            yield _rows(part.column(0).take(at), part.column(2).take(at), [len(own.tokens[x[0]]) for x in found], [x[1:] for x in found])

    return grouping.map_arrow(joined.select("doc_id", "text", "item_id", "item_text"), tiled, f"doc_id {types[0]}, item_id {types[1]}, {_SCHEMA}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns; one pass over the texts, no shuffle of them."""
    items = benchmark.select(F.col("text").cast("string").alias("item_text"))
    size = items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    if size > max_broadcast_bytes:
        key = ta.own_column(docs, "row_key")
        keyed = docs.withColumn(key, F.xxhash64(F.col(text).cast("string")))
        named = benchmark.select(F.monotonically_increasing_id().alias("item_id"), "text")
        gone = contaminations(keyed, named, text, key, "item_id", "text", least, coverage, max_broadcast_bytes).select(F.col("doc_id").alias(key)).distinct()
        return keyed.join(gone, key, "left_anti").drop(key)
    shared = docs.sparkSession.sparkContext.broadcast(Seeds([r["item_text"] for r in items.collect()], least))
    own = ta.own_column(docs, "text_to_tile")

    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for part in ta.chunks(batch, own):
            hashes, _, _, first = ta.words(*ta.packed(part.column(part.num_columns - 1), "utf8"))
            keep = np.ones(part.num_rows, bool)
            for row in _seeded(seeds, hashes, first):
                keep[row] = all(x[2] < coverage for x in coverages(seeds, hashes[first[row] : first[row + 1]]))
            left = part.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(left.columns[:-1], left.schema.names[:-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return grouping.map_arrow(docs.withColumn(own, F.col(text).cast("string")), clean, schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "coverage", "n_tokens", "n_covered", F.size("tiles").alias("n_tiles"))
