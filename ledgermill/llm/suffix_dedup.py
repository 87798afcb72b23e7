"""Removal of every byte that lies in a repeated 200-byte string, by interval expansion on Burrows-Wheeler transforms.

A window is a string of `LENGTH` bytes. Its key is the least hash among its runs of `ANCHOR` bytes, so equal windows have equal keys
wherever they stand, and the windows of a text fall into runs of one key, some 80 each. What may be equal is brought together by key:

1. Keys (no text) are counted over all documents; runs whose key stands nowhere else are done with. So are those whose key always stands in
   the same run of text (by a second hash): copies are summed before any text travels, and each window of such a run is repeated.
2. The text of the other runs is cut out of the documents, once for each distinct run and task.
3. Runs are dealt by key into bins of about `BIN_BYTES`. The distinct runs of a bin are one text with a separator after each. From its
   Burrows-Wheeler transform, classes of rows with equal prefixes are parted breadth-first by backward extension, so the common prefixes of
   neighbouring suffixes come out by increasing value; at LENGTH - 1 it stops, and neighbours not yet parted share LENGTH bytes or more.

A key with more than `HOT` distinct runs (a passage in a third of all documents) isn't put into one bin: the windows of its distinct runs are counted
by their own hash first, and two copies of each that stands in several go to the bins, dealt by that hash.

Defined cases: a null text is an empty one; texts of under LENGTH bytes lose nothing; repeated rows are documents of their own, so they lose
every byte that a window covers; null and repeated ids are allowed; other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping
from . import textarrays as ta
from .pieces import _ranges

LENGTH, ANCHOR = 200, 40
#: Windows of a run; longer ones (a text that repeats itself closely) are parted.
MAX_RUN = 256
HOT = 6000
BIN_BYTES = 1 << 20
#: Windows that are hashed at once.
BLOCK = 1 << 20
_SEED = np.uint64(0xC2B2AE3D27D4EB4F)


def sliding(x: np.ndarray, width: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or greatest) of each `width` successive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def runs(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: key, text (its row), first window (its byte in the text), number of windows, digest, whether the key recurs.

    The digest is a hash of the run's whole text. Where a key stands at one place of a run only, no two of the run's windows are equal.
    """
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(0, bool))]
    width = length - anchor + 1
    end_of = np.repeat(offs[1:], np.diff(offs))
    row_of = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    for at in range(0, len(buf) - length + 1, BLOCK):
        part = buf[at : at + BLOCK + length - 1]
        sums = ta.prefix_sums(part)
        hashes = ta.mix((sums[anchor:] - sums[:-anchor]) * ta.powers(len(sums))[1][: len(sums) - anchor])
        key = sliding(hashes, width)
        row = row_of[at : at + len(key)]
        whole = np.arange(at + length, at + length + len(key)) <= end_of[at : at + len(key)]
        first = whole.copy()
        first[1:] &= (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        begins = np.flatnonzero(first)
        if not len(begins):
            continue
        stops = whole.copy()
        stops[:-1] &= first[1:] | ~whole[1:]
        ends = np.flatnonzero(stops) + 1
        pieces = -((begins - ends) // MAX_RUN)
        piece_at = np.repeat(begins, pieces) + MAX_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        n = np.minimum(np.repeat(ends, pieces) - piece_at, MAX_RUN)
        # A place is some window's least if the greatest key of the windows around it is its own hash; equal neighbours of these recur.
        least = np.flatnonzero(sliding(np.pad(key, width - 1), width, np.maximum)[: len(hashes)] == hashes)
        pairs = np.concatenate([[0], np.cumsum(hashes[least[1:]] == hashes[least[:-1]])])
        low, high = np.searchsorted(least, piece_at), np.searchsorted(least, piece_at + n + width - 1) - 1
        recurs = (high > low) & (pairs[np.minimum(high, len(pairs) - 1)] > pairs[np.minimum(low, len(pairs) - 1)])
        digest = ta.range_hashes(sums, piece_at, piece_at + n + length - 1)
        out.append((key[piece_at], row[piece_at].astype(np.int64), piece_at + at - offs[row[piece_at]], n, digest, recurs))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; symbols are 0 to 510."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(6, np.int64)])
    key = wide[:n].copy()
    for j in range(1, 7):
        key <<= 9
        key |= wide[j : j + n]
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(2 * n, np.int32)
    rank[n:] = -1
    slots = np.arange(n, dtype=np.int32)
    values, known = key[order], 7
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = values[1:] != values[:-1]
        group = np.flatnonzero(new)
        sizes = np.diff(np.append(group, len(slots)))
        rank[order[slots]] = np.repeat(slots[group], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order
        own = order[slots]
        values = (rank[own].astype(np.int64) << 32) + rank[np.minimum(own + known, n)] + 1
        by = np.argsort(values)
        order[slots], values = own[by], values[by]
        known *= 2


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For all segments one after another, each followed by one more place: whether `length` equal bytes start elsewhere too.

    Common prefixes of neighbouring suffixes are derived by increasing value, up to length - 1; what is left shares more.
    """
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, bool)
    ends = np.cumsum(sizes) - 1
    symbols = np.zeros(n, np.int16)
    inside = np.ones(n, bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    order = suffix_order(symbols)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    transform = symbols[order - 1]
    back = place[order - 1]
    by_symbol = np.argsort(transform, kind="stable").astype(np.int32)
    same = (transform[by_symbol[1:]] == transform[by_symbol[:-1]]) & (transform[by_symbol[1:]] != 0)
    following, preceding = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    heads = symbols[order]
    common = np.full(n, -1, np.int16)
    found = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]) | (heads[1:] == 0)]))
    common[found] = 0
    found = found[1:]
    label, low, high, labels = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, n, np.int32), 1
    for level in range(length - 1):
        if not len(found):
            break
        # Each class that has new boundaries is parted; its largest part keeps the label, so a row is seen few times.
        own = label[found]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        at = np.arange(len(found)) + np.cumsum(first)
        begin = np.empty(len(found) + int(first.sum()), np.int64)
        head = at[first] - 1
        begin[at], begin[head] = found, low[own[first]]
        stop = np.append(begin[1:], 0)
        stop[np.append(head[1:] - 1, len(begin) - 1)] = high[own[first]]
        which = np.zeros(len(begin), np.int64)
        which[head] = 1
        which = np.cumsum(which) - 1
        size = stop - begin
        largest = np.maximum.reduceat(size * len(begin) + np.arange(len(begin)), head) % len(begin)
        low[own[first]], high[own[first]] = begin[largest], stop[largest]
        small = np.ones(len(begin), bool)
        small[largest] = False
        named = np.arange(labels, labels + int(small.sum()), dtype=np.int32)
        labels += len(named)
        low[named], high[named] = begin[small], stop[small]
        rows = _ranges(begin[small], size[small])
        label[rows] = np.repeat(named, size[small])
        later, earlier = following[rows], preceding[rows]
        later = later[(later >= 0) & (label[later] != label[rows])]
        behind = rows[(earlier >= 0) & (label[earlier] != label[rows])]
        found = np.concatenate([back[later], back[behind]])
        found = np.sort(found[common[found] < 0])
        found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
        common[found] = level + 1
    shares = common < 0
    out = np.zeros(n, bool)
    out[order] = shares | np.append(shares[1:], False)
    return out


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, k1, k2, text): rows alike in id and text share their keys."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return docs.select("doc_id", F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), "text")


_KEYS = "key long, k1 long, k2 long, start int, n int, digest long, recurs boolean"


def _keys(batch: pa.RecordBatch, length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for part in ta.chunks(batch):
        key, row, start, n, digest, recurs = runs(*ta.packed(part.column(2)), length, anchor)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(digest.view(np.int64)), pa.array(recurs)], ["key", "k1", "k2", "start", "n", "digest", "recurs"])


def _cut_out(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, digest, k1, k2, start, n, hot, bytes): the chosen runs, with their bytes where the task doesn't remember having given them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in ta.chunks(batch):
                if len(seen) > 1 << 18:  # the bytes are given more often then
                    seen.clear()
                buf, offs = ta.packed(part.column(2))
                data, chosen = buf.tobytes(), part.column(3)
                row = np.repeat(np.arange(part.num_rows), chosen.value_lengths().to_numpy(zero_copy_only=False))
                of = chosen.flatten()
                key, digest, start, n = (of.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                begin = offs[row] + start
                texts: list[bytes | None] = []
                for a, b, *own in zip(begin.tolist(), (begin + n + length - 1).tolist(), key.tolist(), digest.tolist()):
                    name = tuple(own)
                    texts.append(None if name in seen else data[a:b])
                    seen.add(name)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([of.field(0), of.field(1), part.column(0).take(rows), part.column(1).take(rows), of.field(2), of.field(3), of.field(4), pa.array(texts, pa.binary())], ["key", "digest", "k1", "k2", "start", "n", "hot", "bytes"])

    return task


def _bins(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, digest, start, n): stretches of repeated windows in each run, from rows (key, digest, bytes) sorted by key and digest."""

    def expand(held: list[list]) -> pa.RecordBatch:
        repeated = repeated_starts([x[2] for x in held], length)
        sizes = np.array([len(x[2]) + 1 for x in held], np.int64)
        firsts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero([x[3] > 1 for x in held]).tolist():  # copies of one run
            repeated[firsts[i] : firsts[i] + sizes[i] - length] = True
        at = np.flatnonzero(np.diff(np.concatenate([[False], repeated, [False]]).astype(np.int8)))
        begin, end = at[::2], at[1::2]
        of = np.searchsorted(firsts, begin, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in of], pa.int64()), pa.array([held[i][1] for i in of], pa.int64()), pa.array((begin - firsts[of]).astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["key", "digest", "start", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size = 0
        for batch in batches:
            for key, digest, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                last = held[-1] if held else [None, None]
                if key == last[0] and digest == last[1]:
                    last[3] += 1
                    if last[2] is None and own is not None:
                        last[2] = own
                        size += len(own)
                    continue
                if size >= BIN_BYTES and key != last[0]:
                    yield expand(held)
                    held, size = [], 0
                held.append([key, digest, own, 1])
                size += len(own or b"")
        if held:
            yield expand(held)

    return task


def _windows(length: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """(window, key, digest, start, many): every window of distinct hot runs, by a hash of its own; many is how often the run stands."""

    def task(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, "bytes"):
            column = part.column(3)
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            buf = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            n = sizes - length + 1
            row, starts = np.repeat(np.arange(len(sizes)), n), _ranges(np.cumsum(sizes) - sizes, n)
            hashes = ta.mix(ta.range_hashes(ta.prefix_sums(buf), starts, starts + length) ^ _SEED)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array(_ranges(np.zeros(len(n), np.int64), n).astype(np.int32)), part.column(2).take(rows)], ["window", "key", "digest", "start", "many"])

    return task


def _chosen_windows(length: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """(key, digest, bytes): chosen windows as runs of their own, keyed by their hash and told apart by where they stand."""

    def task(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch, "bytes"):
            rows = [(x["window"], x["place"], own[x["start"] : x["start"] + length]) for own, chosen in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in chosen]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], ["key", "digest", "bytes"])

    return task


_FOUND = "key long, digest long, start int, n int"


def _hot_repeats(hot: DataFrame, length: int) -> DataFrame:
    """(key, digest, start, n) of the repeated windows of runs with hot keys; hot has key, digest, bytes."""
    hot = grouping.cut(hot.groupBy("key", "digest").agg(F.count("*").alias("many"), F.max("bytes").alias("bytes")))
    windows = grouping.cut(grouping.map_arrow(hot.select("key", "digest", "many", "bytes"), _windows(length), "window long, key long, digest long, start int, many long"))
    place = F.struct("key", "digest", "start")
    several = windows.groupBy("window").agg(F.sum("many").alias("many"), F.min(place).alias("a"), F.max(place).alias("b")).where("many > 1")
    alone = several.where("a = b").select("a.*")
    two = several.where("a != b").select("window", F.explode(F.array("a", "b")).alias("at")).select("window", "at.*")
    wanted = two.withColumn("place", F.xxhash64("key", "digest", "start")).groupBy("key", "digest").agg(F.collect_list(F.struct("window", "start", "place")).alias("chosen"))
    texts = hot.join(wanted, ["key", "digest"]).select("bytes", "chosen")
    dealt = grouping.map_arrow(texts, _chosen_windows(length), "key long, digest long, bytes binary").repartition("key").sortWithinPartitions("key", "digest")
    confirmed = dealt.mapInArrow(_bins(length), _FOUND).select(F.col("key").alias("window")).distinct()
    single = windows.join(confirmed, "window").select("key", "digest", "start").union(alone)
    starts = single.groupBy("key", "digest").agg(F.sort_array(F.collect_set("start")).alias("s"))
    firsts = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1) != x - 1))
    lasts = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1) != x + 1))
    stretches = F.inline(F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n"))))
    return starts.select("key", "digest", stretches)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): for each row's keys, the byte ranges [begin, end) that repeated windows cover, unsorted, overlapping."""
    docs = _keyed(docs, text, doc_id)
    keys = grouping.cut(grouping.map_arrow(docs.select("k1", "k2", "text"), lambda b: _keys(b, length, anchor), _KEYS))
    counts = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("digest").alias("a"), F.max("digest").alias("b"), F.max("recurs").alias("recurs")).where("size > 1 or recurs")
    shared = keys.drop("recurs").join(counts.select("key", F.expr("a = b and size > 1").alias("same")), "key")
    shared = grouping.cut(shared)
    span = lambda at, n: F.struct(at.alias("begin"), (at + n - 1 + length).alias("end"))
    copies = shared.where("same").select("k1", "k2", span(F.col("start"), F.col("n")).alias("span"))
    mixed = shared.where("not same")
    kinds = mixed.select("key", "digest").distinct().groupBy("key").agg(F.count("*").alias("kinds"))
    mixed = mixed.join(kinds.where(F.col("kinds") > hot).select("key", F.lit(True).alias("hot")), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    chosen = mixed.groupBy("k1", "k2").agg(F.collect_set(F.struct("key", "digest", "start", "n", "hot")).alias("chosen"))
    texts = docs.select("k1", "k2", "text").join(chosen, ["k1", "k2"])
    occurrences = grouping.cut(texts.mapInArrow(_cut_out(length), "key long, digest long, k1 long, k2 long, start int, n int, hot boolean, bytes binary"))
    cool = occurrences.where("not hot").select("key", "digest", "bytes").repartition("key").sortWithinPartitions("key", "digest")
    found = cool.mapInArrow(_bins(length), _FOUND)
    much = occurrences.where("hot").select("key", "digest", "bytes")
    if not much.isEmpty():
        found = found.union(_hot_repeats(much, length))
    per_run = found.groupBy("key", "digest").agg(F.collect_set(F.struct(F.col("start").alias("at"), F.col("n").alias("many"))).alias("found"))
    placed = occurrences.select("key", "digest", "k1", "k2", "start").join(per_run, ["key", "digest"])
    placed = placed.select("k1", "k2", F.explode(F.transform("found", lambda x: span(F.col("start") + x["at"], x["many"]))).alias("span"))
    return placed.union(copies).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _without(part: pa.RecordBatch) -> tuple[list[bytes], list[int], list[int], list[int]]:
    kept, sizes, removed, n_spans = [], [], [], []
    for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
        data = text.encode()
        at, out, n, last = 0, [], 0, -1
        for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
            if begin > last:
                out.append(data[at:begin])
                n += 1
            last = at = max(last, end)
        out.append(data[at:])
        kept.append(b"".join(out))
        sizes.append(len(data))
        removed.append(len(data) - len(kept[-1]))
        n_spans.append(n)
    return kept, sizes, removed, n_spans


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans) and the remaining bytes in kept (digest: their SHA-256 in kept_sha256), a row for each row of docs."""
    spans = repeated_spans(docs, text, doc_id, length, anchor, hot)
    rows = _keyed(docs, text, doc_id).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def task(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch):
            kept, sizes, removed, n_spans = _without(part)
            last = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, n_spans)), last], ["doc_id", "n_bytes", "n_removed", "n_spans", "last"])

    done = grouping.map_arrow(rows, task, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, last {'string' if digest else 'binary'}")
    return done.withColumnRenamed("last", "kept_sha256" if digest else "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
