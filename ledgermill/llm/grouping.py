"""Candidate blocks, verified links and their connected groups, as Spark joins that no single block can swamp."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut, shared_folder  # noqa: F401

#: Blocks of at most this many members compare every pair of them at once; larger ones go by rounds of leaders.
SMALL_BLOCK = 12
#: Members of a large block that meet its leaders in one task.
TILE = 1024
#: How many times as many leaders each next round has.
MORE_LEADERS = 64
#: Bits of the filter that is broadcast before texts of chosen nodes are fetched: some 16 a node, up to 16 MB.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 27
#: Up to so many rows a key that has them all is no load for a task.
FEW_ROWS = 100_000
#: A key that has more than this share of all rows of a join is hot; there can be no more hot keys than its inverse.
HOT_SHARE = 1 / 1024


def links(keys: DataFrame, similarity: float, fetch: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame, DataFrame], DataFrame], grams: Callable[[DataFrame], DataFrame] | None = None, small: int = SMALL_BLOCK) -> DataFrame:
    """The groups that nodes which share a block form by verified pairs, each as a star of edges (a: the group's least node, b: another one).

    keys has the columns (node, total, blocks), where total is the node's weight. fetch gives the contents of chosen nodes, verify keeps the
    pairs that are alike by those contents. Two nodes can only be alike if the lesser total is at least `similarity` of the greater.

    The groups are those of all pairs that share a block. Up to `small` nodes that share a block are compared pair by pair. For the nodes of larger
    blocks, grams, if given, gives the weighted elements of contents (node, gram, weight) by which alike nodes share `similarity` of each one's
    weight; such nodes share one of their rarest elements (`rarest_blocks`), so these take the blocks' place: no alike pair is lost, and
    nodes that share only what is common don't meet. In the block of its rarest shared element, a pair shares no more than what either has from
    that element on (rest); a pair that could not be alike by that is left out there. What is still large goes by rounds: leaders are compared with every node of the block that isn't
    known to be of their group, then leave it, as all their pairs are settled. A pair of one group needs no comparison, so leaders come from
    outside the block's largest group, the first one being the node that has most of what is common, and the block ends when one group is
    left: a block of near copies of one text at one comparison a node. Each round has more leaders, the last one all that are left. Leaders
    meet a block in tiles, so no task holds a block.
    """
    flat = keys.select(F.explode("blocks").alias("block"), "node", "total")
    several = flat.groupBy("block").agg(F.count("*").alias("n")).where("n > 1").select("block")
    flat = cut(flat.join(several, "block").groupBy("block", "node").agg(F.first("total").alias("total")))
    flat = cut(_with_sizes(flat)).withColumns({"rest": F.col("total").cast("double"), "centre": F.lit(0.0)})
    left = flat.where(F.col("size") > small).drop("size")
    pairs = _all_pairs(flat.where(F.col("size") <= small), similarity)
    if grams is not None:
        left = cut(_with_sizes(rarest_blocks(grams(fetch(left.select("node").distinct())), similarity)))
        pairs = pairs.union(_all_pairs(left.where(F.col("size") <= small), similarity))
        left = left.where(F.col("size") > small).drop("size")
    pairs = cut(pairs.distinct())
    contents = cut(fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(left.select("node")).distinct()))
    left = left.withColumn("root", F.col("node"))
    known, stars, depth = None, None, 0
    while True:
        groups = left.groupBy("block", "root").agg(F.count("*").alias("n"))
        tops = groups.groupBy("block").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("top")).where("top.n < size")
        left = cut(left.join(tops, "block"))
        many = not left.isEmpty()
        if not many and stars is not None:
            return stars
        if many:
            tiles = F.ceil(F.col("size") / TILE)
            others = left.where("root != top.root").withColumn("order", F.xxhash64("node", F.lit(depth)))
            lead = F.struct(F.col("node").alias("leader"), F.col("root").alias("lead_root"), F.col("total").alias("lead_total"), F.col("rest").alias("lead_rest"), tiles.alias("tiles"))
            draw = F.pmod("order", F.lit(1 << 40)) / F.lit(float(1 << 40))
            all_lead = (F.col("size") <= small) | (draw < F.lit(float(MORE_LEADERS**depth)) / (F.col("size") - F.col("top.n")))
            one = others.groupBy("block").agg(F.max_by(lead, F.struct("centre", "order")).alias("lead"))
            leaders = cut(one.union(others.where(all_lead).select("block", lead.alias("lead"))).distinct().select("block", "lead.*"))
            members = left.withColumn("tile", F.pmod(F.xxhash64("node"), tiles))
            met = members.join(leaders.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))), ["block", "tile"])
            met = met.where("root != lead_root").where(_near("total", "rest", "lead_total", "lead_rest", similarity)).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
            pairs = met if stars is not None else pairs.union(met)
        pairs = pairs.distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        passed = verify(pairs, contents).select("a", "b")
        roots = cut(connected(passed if stars is None else stars.union(passed)))
        stars = roots.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        known = pairs if known is None else known.union(pairs)
        if not many:
            return stars
        rest = left.select("block", "node", "total", "rest", "centre").join(leaders.select("block", F.col("leader").alias("node")), ["block", "node"], "left_anti")
        left = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        depth += 1


def _with_sizes(flat: DataFrame) -> DataFrame:
    """The rows of blocks of more than one node, with the block's size."""
    return flat.join(flat.groupBy("block").agg(F.count("*").alias("size")).where("size > 1"), "block")


def _near(total: str, rest: str, other_total: str, other_rest: str, similarity: float) -> Column:
    """Whether two nodes can be alike by what they share at most: it is `similarity` of all that both have."""
    shared = F.least(rest, other_rest)
    return shared * (1 + 1e-6) >= similarity * (F.col(total) + F.col(other_total) - shared)


def rarest_blocks(grams: DataFrame, similarity: float) -> DataFrame:
    """(node, block, total, rest, centre): each node's rarest elements, as many as leave less than `similarity` of its weight.

    total is the node's weight, rest its weight from that element on, and centre its elements' mean frequency.

    Elements are ordered by how many of these nodes have them, then by themselves. If two nodes share at least `similarity` of each one's
    weight, their rarest shared element is among those of both: what comes after it is too little to be all that they share.
    """
    grams = cut(grams)
    counts = grams.groupBy("gram").agg(F.count("*").alias("df")).withColumn("n", F.col("df"))
    ranked = join_few(grams, counts, "gram", "n", grams.count()).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "weight"))).alias("grams"), F.avg("df").alias("centre"))

    def rarest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        flat, n = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(n)), n)
        weight = flat.field(2).to_numpy(zero_copy_only=False).astype(float)
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        ends = sums[np.cumsum(n)]
        rest, total = ends[row] - sums[:-1], ends - sums[np.cumsum(n) - n]
        at = np.flatnonzero(rest * (1 + 1e-6) >= similarity * total[row])
        own = pa.array(row[at])
        columns = [batch.column(0).take(own), flat.field(1).take(pa.array(at)), pa.array(total[row[at]]), pa.array(rest[at]), batch.column(2).take(own)]
        yield pa.RecordBatch.from_arrays(columns, ["node", "block", "total", "rest", "centre"])

    return map_arrow(ranked, rarest, f"node {dict(grams.dtypes)['node']}, block long, total double, rest double, centre double")


def _all_pairs(blocks: DataFrame, similarity: float) -> DataFrame:
    """The pairs of each block whose totals let them be alike; only for blocks of bounded size."""
    side = lambda x: blocks.select("block", F.col("node").alias(x), F.col("total").alias(f"{x}_total"), F.col("rest").alias(f"{x}_rest"))
    return side("a").join(side("b"), "block").where("a < b").where(_near("a_total", "a_rest", "b_total", "b_rest", similarity)).select("a", "b")


def join_few(rows: DataFrame, few: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined to one row a key of few, which has the number n of rows that the key has; total is the number of all rows.

    Keys with more than HOT_SHARE of the rows, which can't be many, are broadcast, so that their rows stay where they are.
    """
    if total <= FEW_ROWS:
        return rows.join(few.drop(n), key)
    hot = F.col(n) > max(1000, int(total * HOT_SHARE))
    hubs = F.broadcast(few.where(hot).drop(n))
    return rows.join(hubs, key).unionByName(rows.join(F.broadcast(few.where(hot).select(key)), key, "left_anti").join(few.where(~hot).drop(n), key))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternate large-star and small-star joins until all groups are stars.

    The root is the group's least node. The least neighbours of hubs are broadcast, so no task holds a hub's edges.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        total = edges.count()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
        large = join_few(both.where("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = cut(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
        small = join_few(large, least, "u", "n", total).where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = cut(small.union(least.select("u", F.col("least").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node is either once an outer end, or only a centre."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("outer"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    roles = ends.groupBy("node").agg(F.sum("outer").alias("outer"), F.max("centre").alias("centre"))
    return roles.where("outer > 1 or outer > 0 and centre > 0").isEmpty()


def node_filter(nodes: DataFrame) -> np.ndarray:
    """Bits that are set for chosen nodes (16 bytes, or longs: their first 64 bits): all of them pass, and few others while it isn't full.

    Its size follows the number of nodes up to a bound; what passes beyond them is dropped by the join that follows. Segments of it are packed in tasks.
    """
    many = nodes.count()
    size = min(max(1 << (16 * many).bit_length(), LEAST_FILTER_BITS), MOST_FILTER_BITS)
    high = F.col("node") if dict(nodes.dtypes)["node"] == "bigint" else F.conv(F.substring(F.hex("node"), 1, 16), 16, -10).cast("long")
    bit = F.shiftrightunsigned(high, 16).bitwiseAND(F.lit(size - 1))
    spots = nodes.select(F.floor(bit / 65536).cast("int").alias("segment"), (bit % 65536).cast("int").alias("spot")).distinct()

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for found in batch.column(1):
            bits = np.zeros(65536, bool)
            bits[found.values.to_numpy()] = True
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["segment", "bits"])

    bits = np.zeros(size // 8, np.uint8)
    for row in map_arrow(spots.groupBy("segment").agg(F.collect_list("spot").alias("spots")), pack, "segment int, bits binary").toLocalIterator():
        bits[row["segment"] * 8192 : (row["segment"] + 1) * 8192] = np.frombuffer(row["bits"], np.uint8)
    return bits


def passes(bits: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places of nodes that the filter lets pass, from their first 64 bits."""
    bit = (high >> np.uint64(16)) & np.uint64(8 * len(bits) - 1)
    return np.flatnonzero(bits[(bit >> np.uint64(3)).astype(np.int64)] & (np.uint8(128) >> (bit & np.uint64(7)).astype(np.uint8)))


def not_given(given: set[int], high: np.ndarray) -> np.ndarray:
    """The places of nodes that a task hasn't given yet; it forgets what it gave when that is much, and gives some again then."""
    if len(given) > 1 << 17:
        given.clear()
    _, first = np.unique(high, return_index=True)
    new = [i for i in np.sort(first).tolist() if int(high[i]) not in given]
    given.update(int(high[i]) for i in new)
    return np.array(new, np.int64)


def node_ids(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """128-bit nodes as 16 bytes each."""
    data = np.stack([high, low], 1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer((np.arange(len(high) + 1) * 16).astype(np.int32)), pa.py_buffer(data)])


def map_arrow(frame: DataFrame, task: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from task(batch)

    return frame.mapInArrow(run, schema)
