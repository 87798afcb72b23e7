"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is the weighted set of its five-word shingles; a weight is the shingle's count times an inverse document frequency. The
frequencies of all documents are counted into `DF_CELLS` hashed cells, so the table that is broadcast has a fixed size; a cell holds at
least the frequency of each of its shingles, and shingles in more than a few thousandths of all documents stand out. The factor is
damped to 1 ... 1 + IDF_SPREAD: the shared shingles of a large group of near copies are frequent because of that group, and an
undamped factor would make the group's few edits outweigh what its members share.

Equal documents (the same words, whatever case and punctuation) are one node from the start. Samples are taken where the text is
read, 12 bands of 4; texts travel only for nodes that share a band with another node.

Defined cases: null and wordless texts are one class; repeated rows and rows with equal or null ids are documents of their own; the class id
is the least doc_id of the class, null if all its ids are. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping
from . import textarrays as ta
from .paragraph_dedup import contents

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
DF_CELLS = 1 << 18
IDF_SPREAD = 0.25
_TABLE_BITS = 16
_rng = np.random.default_rng(20240502)
_SHAPE = (BANDS * ROWS, 1 << _TABLE_BITS)
#: The method's three variables of an element, for each sample: r and c are Gamma(2, 1), beta is uniform.
_R = _rng.gamma(2.0, 1.0, _SHAPE).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, _SHAPE)).astype(np.float32)
_BETA = _rng.random(_SHAPE, dtype=np.float32)
_ROTATE = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's two content hashes, then its distinct shingles with their counts, and each text's first one."""
    hashes, _, _, first = ta.words(*ta.packed(column, "utf8"))
    high, low = contents(hashes, first)
    grams, _, gram_first = ta.shingles(hashes, first, WORDS)
    row = np.repeat(np.arange(len(column)), np.diff(gram_first)).astype(np.uint64)
    order = np.lexsort((grams, row)) if len(column) > 1 << 20 else np.argsort((row << np.uint64(44)) | (grams >> np.uint64(20)), kind="stable")
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(grams)]]))
    return high, low, grams[at], counts, np.searchsorted(row[at], np.arange(len(column) + 1).astype(np.uint64))


def cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - DF_CELLS.bit_length() + 1)).astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The damped inverse document frequency of every cell, counted over all rows of docs (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DF_CELLS + 1, np.int64)
        for part in ta.text_batches(batches):
            _, _, grams, _, first = grams_of(part.column(0))
            total[:-1] += np.bincount(cells(grams), minlength=DF_CELLS)
            total[-1] += len(first) - 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = docs.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    frequencies = np.zeros(DF_CELLS + 1)
    frequencies[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    n = max(frequencies[-1], 2.0)
    rare = np.log(n / np.clip(frequencies[:-1], 1.0, n)) / np.log(n)
    return (1.0 + IDF_SPREAD * rare).astype(np.float32)


def samples(grams: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Band hashes, one row a text that has shingles: of each sample, the chosen element and its quantised weight."""
    log_weight = np.log(weights).astype(np.float32)
    names = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS):
        at = ((grams * _ROTATE[k]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        r = _R[k][at]
        t = np.floor(log_weight / r + _BETA[k][at])
        log_a = _LOG_C[k][at] - r * (t - _BETA[k][at] + np.float32(1))
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        packed = (ordered << np.uint64(32)) | (names + t.astype(np.int32).view(np.uint32))
        out[:, k] = np.minimum.reduceat(packed, first[:-1]).astype(np.uint32)
    wide = ta.mix(out.astype(np.uint64) + np.arange(BANDS * ROWS, dtype=np.uint64) * np.uint64(1 << 32))
    return np.stack([ta.mix(wide[:, b * ROWS : (b + 1) * ROWS].sum(1, dtype=np.uint64) + np.uint64(b)) for b in range(BANDS)], 1)


def similarities(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity, row by row: the sum of the lesser weights over the sum of the greater."""
    rows, grams, weights = [], [], []
    for column in (left, right):
        _, _, of, counts, first = grams_of(column)
        rows.append(np.repeat(np.arange(len(column)), np.diff(first)))
        grams.append(of)
        weights.append(counts * idf[cells(of)].astype(float))
    row, gram, weight = (np.concatenate(x) for x in (rows, grams, weights))
    order = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (gram >> np.uint64(20)), kind="stable")
    row, gram, weight = row[order], gram[order], weight[order]
    same = np.flatnonzero((gram[1:] == gram[:-1]) & (row[1:] == row[:-1]))
    least = np.bincount(row[same], np.minimum(weight[same], weight[same + 1]), len(left))
    union = np.bincount(row, weight, len(left)) - least
    return np.where(union > 0, least / np.maximum(union, 1e-9), 1.0)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, node, class_node): every document with its class.

    node names a document's words (16 bytes), class_node the class; documents of one node are copies.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows.select("text")))

    def signed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch):
            high, low, grams, counts, first = grams_of(part.column(1))
            weights = counts * idf.value[cells(grams)]
            total = np.bincount(np.repeat(np.arange(len(high)), np.diff(first)), weights, len(high)).astype(np.float32)
            bands: list = [[]] * len(high)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                found = samples(grams, weights, np.concatenate([first[some], first[-1:]]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(first) > 0)]).astype(np.int32) * BANDS), pa.array(found.view(np.int64).ravel()))
            else:
                lists = pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), grouping.node_ids(high, low), pa.array(total), lists], ["doc_id", "node", "total", "blocks"])

    signed_rows = grouping.cut(grouping.map_arrow(rows, signed, f"doc_id {id_type}, node binary, total float, blocks array<bigint>"))
    nodes = grouping.cut(signed_rows.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.first("total").alias("total"), F.first("blocks").alias("blocks")))
    fetch = lambda chosen: texts_of(rows.select("text"), chosen)
    pairs = grouping.links(nodes.select("node", "total", "blocks"), similarity, fetch, lambda pairs, texts: verified(pairs, texts, idf, similarity), lambda texts: weighted_grams(texts, idf))
    roots = grouping.connected(pairs)
    sums = nodes.select("node", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = sums.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("least").alias("class_id"))
    by_node = sums.select("node", "root").join(classes, "root")
    return signed_rows.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "class_size", "node", F.col("root").alias("class_node"))


def texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the chosen nodes, one row each."""
    bits = rows.sparkSession.sparkContext.broadcast(grouping.node_filter(nodes))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for part in ta.text_batches(batches):
            hashes, _, _, first = ta.words(*ta.packed(part.column(0), "utf8"))
            high, low = contents(hashes, first)
            at = grouping.passes(bits.value, high)
            at = at[grouping.not_given(given, high[at])]
            yield pa.RecordBatch.from_arrays([grouping.node_ids(high[at], low[at]), part.column(0).take(pa.array(at))], ["node", "text"])

    found = rows.mapInArrow(chosen, "node binary, text string")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def weighted_grams(texts: DataFrame, idf) -> DataFrame:
    """(node, gram, weight): each node's distinct shingles."""

    def weighed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch):
            _, _, grams, counts, first = grams_of(part.column(1))
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(grams.view(np.int64)), pa.array((counts * idf.value[cells(grams)]).astype(np.float32))], ["node", "gram", "weight"])

    return grouping.map_arrow(texts.select("node", "text"), weighed, "node binary, gram long, weight float")


def verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    def close(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, "a_text", ta.CHUNK_BYTES // 2):
            keep = pa.array(np.flatnonzero(similarities(part.column(2), part.column(3), idf.value) >= similarity))
            yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return grouping.map_arrow(joined.select("a", "b", "a_text", "b_text"), close, "a binary, b binary")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs with one document left of each class: the first by (doc_id, words), null ids last, and one of equal rows."""
    classes = near_duplicates(docs, text, doc_id, similarity)
    firsts = classes.groupBy("class_node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first"))
    node, key = ta.own_column(docs, "node"), ta.own_column(docs, "row_key")
    keepers = firsts.select(F.col("first.node").alias(node), null_safe_key(F.col("first.doc_id")).alias(key))
    own = ta.own_column(docs, "text_to_hash")

    def with_node(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, own):
            hashes, _, _, first = ta.words(*ta.packed(part.column(part.num_columns - 1), "utf8"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], grouping.node_ids(*contents(hashes, first))], [*part.schema.names[:-1], node])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{node}` binary"])
    rows = grouping.map_arrow(docs.withColumn(own, F.col(text).cast("string")), with_node, schema).withColumn(key, null_safe_key(F.col(doc_id)))
    return rows.join(keepers, [node, key], "left_semi").dropDuplicates([node, key]).select(*docs.columns)


def null_safe_key(column):
    """A string that is equal for equal values and for nulls."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size")
