"""Substring dedup by paragraphs: MinHash banding, exact Jaccard of the colliding paragraphs, removal by connected groups.

A paragraph is a stretch of a text's words between two cuts, whatever lines it is laid out in. Cuts are set by content: one lies before
each word whose hash, taken with the next word's, is the least within `REACH` words on both sides. So a passage that stands in several
texts is cut in the same places in all of them but for its first and last `REACH` words, and gives equal paragraphs (some 13 words each)
wherever it stands and however it is wrapped. Every word of a text is in one paragraph; none is shorter than REACH + 1 words unless it is
the whole text. What remains unseen is a repeat of fewer words than lie between two cuts, in texts that differ around it.

Equal paragraphs (same words, whatever case and punctuation) are one node from the start, so one that is in a third of all documents
is one row in every later join. Signatures are made where the text is read; texts travel only for nodes that collide. In large blocks,
paragraphs meet by their rarest shingles, which alike ones must share.

Defined cases: null, empty and wordless texts have no paragraphs; a text of fewer words than a shingle is a paragraph with one shingle;
repeated rows and rows with equal or null ids are each counted as occurrences; the occurrence kept is the first by (doc_id, paragraph),
null ids last, and one of identical occurrences. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping
from . import textarrays as ta

WORDS, SIMILARITY, REACH = 5, 0.8, 6
#: Paragraphs are short sets (some 9 shingles): at similarity 0.8, 4 bands of 2 rows miss 17 pairs in 1,000; at 0.9, 1 in 800.
BANDS, ROWS = 4, 2
_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_NEXT = np.uint64(0xD1B54A32D192ED03)


def cuts(hashes: np.ndarray, first: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The first word of every paragraph: each text's first one, and content-defined ones more than `reach` words from both ends."""
    n = len(hashes)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n)
    value = hashes.copy()
    value[:-1] ^= ta.mix(hashes[1:] * _NEXT)
    value = ta.mix(value)
    cut = (at - first[row] > reach) & (first[row + 1] - at > reach)
    for j in range(1, reach + 1):
        cut[j:] &= value[j:] < value[:-j]
        cut[:-j] &= value[:-j] <= value[j:]
    cut[first[:-1][np.diff(first) > 0]] = True
    return np.flatnonzero(cut)


def minhashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures, one row a paragraph (each has a shingle at least)."""
    out = np.empty((len(first) - 1, BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(hashes * _FACTORS[k] ^ _SHIFTS[k], first[:-1])
    return out


def band_blocks(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Block keys, one row a paragraph and one column a band."""
    signature = minhashes(grams, first)
    return np.stack([ta.mix((signature[:, b * ROWS : (b + 1) * ROWS] * _FACTORS[:ROWS]).sum(1, dtype=np.uint64) + np.uint64(b)) for b in range(BANDS)], 1)


def contents(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words."""
    at = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    length = np.diff(first).astype(np.uint64)
    both = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(hashes ^ ta.mix(at + np.uint64(seed))), dtype=np.uint64)])
        both.append(ta.mix(sums[first[1:]] - sums[first[:-1]] + length))
    return both[0], both[1]


def distinct_grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of every row's distinct shingles, ordered by row."""
    grams, _, gram_first = ta.shingles(hashes, first, WORDS)
    row = np.repeat(np.arange(len(first) - 1), np.diff(gram_first))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return row[new], grams[new]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    given: set[int] = set()
    for part in ta.text_batches(batches):
        hashes, _, _, text_first = ta.words(*ta.packed(part.column(1), "utf8"))
        if not len(hashes):
            continue
        starts = cuts(hashes, text_first)
        first = np.append(starts, len(hashes))
        text = np.searchsorted(text_first, starts, "right") - 1
        high, low = contents(hashes, first)
        row, grams = distinct_grams(hashes, first)
        totals = np.bincount(row, minlength=len(starts))
        # A task gives the blocks of a paragraph once; later occurrences are rows without blocks.
        new = grouping.not_given(given, high)
        fresh = np.zeros(len(starts), bool)
        fresh[new] = True
        taken = fresh[row]
        blocks = band_blocks(grams[taken], np.concatenate([[0], np.cumsum(totals[fresh])]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32) * BANDS, pa.int32()), pa.array(blocks.view(np.int64).ravel()))
        number = np.arange(len(starts)) - np.searchsorted(text, text)
        columns = [part.column(0).take(pa.array(text)), *(pa.array(x.astype(np.int32)) for x in (number, starts - text_first[text], np.diff(first), totals)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "paragraph", "first_word", "n_words", "total", "node", "check", "blocks"])


def _texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the chosen nodes, one row each; the texts are lower-cased."""
    bits = rows.sparkSession.sparkContext.broadcast(grouping.node_filter(nodes))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for part in ta.text_batches(batches):
            buf, offs = ta.packed(part.column(1), "utf8")
            hashes, starts, ends, text_first = ta.words(buf, offs)
            if not len(hashes):
                continue
            first = np.append(cuts(hashes, text_first), len(hashes))
            high, _ = contents(hashes, first)
            at = grouping.passes(bits.value, high)
            at = at[grouping.not_given(given, high[at])]
            data = buf.tobytes()
            texts = [data[a:b].decode() for a, b in zip(starts[first[at]].tolist(), ends[first[at + 1] - 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(high[at].view(np.int64)), pa.array(texts, pa.string())], ["node", "text"])

    found = rows.mapInArrow(chosen, "node long, text string")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def shingles_of(texts: DataFrame) -> DataFrame:
    """(node, gram, weight): each node's distinct shingles."""

    def grams(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch):
            hashes, _, _, first = ta.words(*ta.packed(part.column(1), "utf8"))
            row, found = distinct_grams(hashes, first)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(found.view(np.int64)), pa.array(np.ones(len(row), np.float32))], ["node", "gram", "weight"])

    return grouping.map_arrow(texts.select("node", "text"), grams, "node long, gram long, weight float")


def jaccards(left: pa.Array, right: pa.Array, n: int = WORDS) -> np.ndarray:
    """Exact Jaccard similarity of two columns' sets of n-word shingles, row by row."""
    keys = []
    for column in (left, right):
        hashes, _, _, first = ta.words(*ta.packed(column, "utf8"))
        grams, _, gram_first = ta.shingles(hashes, first, n)
        row = np.repeat(np.arange(len(column)), np.diff(gram_first)).astype(np.uint64)
        keys.append(np.unique((row << np.uint64(40)) | (grams >> np.uint64(24))))
    merged, counts = np.unique(np.concatenate(keys), return_counts=True)
    row = (merged >> np.uint64(40)).astype(np.int64)
    union = np.bincount(row, minlength=len(left))
    return np.where(union > 0, np.bincount(row, counts == 2, len(left)) / np.maximum(union, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    def close(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, "a_text"):
            keep = pa.array(np.flatnonzero(jaccards(part.column(2), part.column(3)) >= similarity))
            yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    return grouping.map_arrow(joined.select("a", "b", "a_text", "b_text"), close, "a long, b long")


def duplicate_paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row for every occurrence of a paragraph that has another like it: doc_id, paragraph, first_word, n_words, group_id, group_paragraph, n_occurrences, kept.

    paragraph is the paragraph's number in its text, and first_word its first word's; group_id is the least doc_id of the group, with
    the number of the group's first paragraph there in group_paragraph. All occurrences but the kept one can go.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    signed = grouping.cut(rows.mapInArrow(_signed, f"doc_id {id_type}, paragraph int, first_word int, n_words int, total int, node long, check long, blocks array<bigint>"))
    keys = signed.where("size(blocks) > 0").select("node", F.col("total").cast("float").alias("total"), "blocks")
    pairs = grouping.links(keys, similarity, lambda chosen: _texts(rows, chosen), lambda pairs, texts: verified(pairs, texts, similarity), shingles_of)
    roots = grouping.cut(grouping.connected(pairs))
    # Only paragraphs that are repeated or linked travel on; what each group has is summed before any row meets its group.
    repeated = signed.groupBy("node", "check").agg(F.count("*").alias("n")).where("n > 1").select("node")
    wanted = repeated.union(roots.select("node")).distinct().join(roots, "node", "left")
    linked = grouping.cut(signed.drop("blocks", "total").join(wanted, "node"))
    # Paragraphs without a link are told apart by both of their hashes.
    linked = linked.select("*", F.coalesce("root", "node").alias("group"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("part"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("paragraph"))
    groups = linked.groupBy("group", "part").agg(F.count("*").alias("n_occurrences"), F.min(first).alias("first")).where("n_occurrences > 1")
    by_group = linked.drop("node", "check", "root").join(groups, ["group", "part"])
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph"))
    return by_group.select("doc_id", "paragraph", "first_word", "n_words", F.col("first.doc_id").alias("group_id"), F.col("first.paragraph").alias("group_paragraph"), "n_occurrences", kept.alias("kept"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
