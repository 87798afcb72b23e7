"""A gated recurrent language model in numpy, trained by truncated backpropagation on every training text, with a class-factored output.

Words are counted over all training texts. The output has `TOP_CLASSES` classes of `CLASS_WORDS` words each for the most frequent words, where a
softmax over the class and one over its words depend on the state, and a class for each band of counts [2**k, 2**(k + 1)) of the
others, where a word has its share of the band's count; words never counted are the class of count 0, one type, as in the base score.
The probabilities of all known words, the unknown one and the end of text sum to 1 after any history.

While training, a word's own occurrence is taken out of its count: a word counted once is trained as unknown, one counted twice as
counted once. So the model sees in training what texts beyond the training rows will show.

Training is data-parallel: in each of `ROUNDS` rounds every task takes a share of the training texts (by a hash of the text) from the round's
parameters through truncated backpropagation, Adam steps over `LANES` streams; the tasks' parameters, weighted by their tokens, are averaged.
All training texts are trained on once. Parameters have a fixed size; the counts grow with the corpus and stay in Spark: the most frequent
words, `TABLE_WORDS` at most, are broadcast (24 bytes each), others are joined to the texts they stand in.

Scoring lays whole texts end to end in lanes and carries the state across windows of `SCORE_WINDOW` tokens until the text ends.

Defined cases: a null text is an empty one, whose only token is the end; rows alike in id and text get equal rows (scores up to rounding); rows
with a null id are never learned from (the remainder is null) and are held out; with no training text every token has base probability 1,
that of the one unknown type. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping
from . import textarrays as ta
from .language_id import crc_remainder
from .pieces import _ranges

STATE, TOP_CLASSES, CLASS_WORDS, BANDS = 16, 31, 32, 33
TABLE_WORDS = 1 << 19
WINDOW, LANES, ROUNDS = 16, 256, 2
SCORE_WINDOW, SCORE_LANES = 64, 512
RATE = 0.01
CHUNK_BYTES = 4 << 20
#: The end of a text, as a word's hash.
END = np.uint64(0x7FFFFFFFFFFFFFFE)
TOP = TOP_CLASSES * CLASS_WORDS
CLASSES = TOP_CLASSES + BANDS
_ONE = np.float32(1)


@dataclass(frozen=True)
class Counts:
    """The broadcast words, sorted by hash, with their counts and rank by count; totals; and each band's summed counts."""

    keys: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    tokens: int
    types: int
    once: int
    band_counts: np.ndarray
    top_counts: np.ndarray


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and how many each text has."""
    buf, offs = ta.packed(column, "ascii")
    hashes, _, _, first = ta.words(buf, offs, ~ta.SPACE_BYTES)
    n = np.diff(first)
    out = np.insert(hashes & np.uint64(0x7FFFFFFFFFFFFFFF), first[1:], END)
    return out, n + 1


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over all rows of (text): each task sums what it can hold, Spark sums the tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([y for _, y in held]), len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for part in ta.chunks(batch, limit=CHUNK_BYTES):
                words, n = np.unique(tokens_of(part.column(0))[0], return_counts=True)
                held.append((words, n))
                size += len(words)
                if size > 2_000_000:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return rows.select("text").mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gather_counts(counts: DataFrame, table_words: int = TABLE_WORDS) -> Counts:
    """What is broadcast: all words of counts from the least power of two that leaves no more than table_words of them, and sums over all words."""
    by_band, types = np.zeros(BANDS + 64), np.zeros(BANDS + 64, np.int64)
    for r in counts.groupBy(F.length(F.bin("n")).alias("band")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        by_band[min(r["band"], BANDS - 1)] += r["n"]
        types[r["band"]] += r["types"]
    least = np.flatnonzero(np.cumsum(types[::-1])[::-1] <= table_words)[0]  # types[0] is 0, so 1 or more unless all fit
    top = counts.where(F.col("n") >= F.lit(1 << max(int(least) - 1, 0))).toPandas()
    n, words = top["n"].to_numpy(np.int64), top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    n, words = n[order], words[order]
    falling = np.argsort(-n, kind="stable")
    ranks = np.empty(len(n), np.int64)
    ranks[falling] = np.arange(len(n))
    total, once = int(by_band.sum()), int(by_band[1])
    own = n[falling[:TOP]]
    np.subtract.at(by_band, band_of(own), own)  # the most frequent words have classes of their own
    return Counts(words, n, ranks, total, int(types.sum()), once, by_band[:BANDS], own.astype(float))


def band_of(n: np.ndarray) -> np.ndarray:
    """0 for no count, k + 1 for counts of 2**k and more."""
    return np.minimum(np.frexp(n.astype(float))[1], BANDS - 1)


def looked_up(table: Counts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's count and rank among the broadcast words; -1 where it isn't among them."""
    if not len(table.keys):
        return np.full(len(hashes), -1), np.full(len(hashes), -1)
    own, which = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(table.keys, own), len(table.keys) - 1)
    there = table.keys[at] == own
    return np.where(there, table.counts[at], -1)[which], np.where(there, table.ranks[at], -1)[which]


def symbols_of(counts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A token's symbol: its rank if it is among the most frequent words, else TOP + its band, and BANDS more if the count is a power of two.

    The latter tell training which counts fall to the band below without the token itself.
    """
    power = (counts > 0) & (counts & (counts - 1) == 0)
    return np.where((ranks >= 0) & (ranks < TOP), ranks, TOP + band_of(np.maximum(counts, 0)) + BANDS * power).astype(np.int16)


def as_scored(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols >= TOP + BANDS, symbols - BANDS, symbols)


def as_trained(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols >= TOP + BANDS, symbols - BANDS - 1, symbols)


def class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < TOP, symbols % TOP_CLASSES, symbols - TOP + TOP_CLASSES)


def member_of(symbols: np.ndarray) -> np.ndarray:
    return symbols // TOP_CLASSES


def initial(table: Counts) -> dict[str, np.ndarray]:
    """Parameters that give the words' own frequencies after any history, with small random recurrent weights."""
    rng = np.random.default_rng(20240507)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    n = np.zeros(TOP)
    n[: len(table.top_counts)] = table.top_counts
    words = np.log(n + 0.5).reshape(CLASS_WORDS, TOP_CLASSES).T
    bands = np.maximum(table.band_counts, 0) + 0.5
    bands[0] = max(table.once, 1)
    classes = np.concatenate([(n + 0.5).reshape(CLASS_WORDS, TOP_CLASSES).sum(0), bands])
    gates = np.zeros(3 * STATE, np.float32)
    gates[:STATE] = -1.0  # the update gate keeps most of the state at first
    return {
        "inputs": small(TOP + BANDS + 1, 3 * STATE),  # the last row is the start of a text
        "gates": gates,
        "recur": small(STATE, 2 * STATE),
        "recur_new": small(STATE, STATE),
        "class_out": np.zeros((STATE, CLASSES), np.float32),
        "class_bias": np.log(classes / classes.sum()).astype(np.float32),
        "word_out": np.zeros((TOP_CLASSES, STATE, CLASS_WORDS), np.float32),
        "word_bias": words.astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    x += _ONE
    x *= np.float32(0.5)
    return x


def forward(p: dict[str, np.ndarray], symbols: np.ndarray, state: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, ...]:
    """States, gates and new parts of inputs (time, lane): states[0] = state, states[t + 1] follows input t.

    fresh marks inputs at which a text starts: the state before them is taken as cleared, though states keeps what the lane's last text left.
    """
    steps, lanes = symbols.shape
    states = np.empty((steps + 1, lanes, STATE), np.float32)
    gates = np.empty((steps, lanes, 2 * STATE), np.float32)
    news = np.empty((steps, lanes, STATE), np.float32)
    states[0] = state
    given = p["inputs"][symbols]
    given += p["gates"]
    keep = (~fresh).astype(np.float32)[:, :, None]
    any_fresh = fresh.any(1)
    for t in range(steps):
        before = states[t]
        if any_fresh[t]:
            before = before * keep[t]
        z = np.matmul(before, p["recur"], out=gates[t])
        z += given[t, :, : 2 * STATE]
        _sigmoid(z)
        new = np.matmul(z[:, STATE:] * before, p["recur_new"], out=news[t])
        new += given[t, :, 2 * STATE :]
        np.tanh(new, out=new)
        after = np.subtract(new, before, out=states[t + 1])
        after *= z[:, :STATE]
        after += before
    return states, gates, news


def _soft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums, row by row; logits are bounded, so none overflows."""
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    return x, x.sum(1)


def outputs(p: dict[str, np.ndarray], h: np.ndarray, symbols: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each symbol after state h, and the loss's gradient by h (with grads filled) if asked."""
    n = len(h)
    classes = class_of(symbols)
    own, total = _soft(h @ p["class_out"] + p["class_bias"])
    log = np.log(own[np.arange(n), classes] / total)
    back = None
    if grads is not None:
        own /= total[:, None]
        own[np.arange(n), classes] -= _ONE
        grads["class_out"] += h.T @ own
        grads["class_bias"] += own.sum(0)
        back = own @ p["class_out"].T
    order = np.argsort(classes.astype(np.int16), kind="stable")
    bounds = np.searchsorted(classes[order], np.arange(TOP_CLASSES + 1))
    for k in range(TOP_CLASSES):
        rows = order[bounds[k] : bounds[k + 1]]
        if not len(rows):
            continue
        hk = h[rows]
        member = member_of(symbols[rows])
        words, total = _soft(hk @ p["word_out"][k] + p["word_bias"][k])
        log[rows] += np.log(words[np.arange(len(rows)), member] / total)
        if grads is not None:
            words /= total[:, None]
            words[np.arange(len(rows)), member] -= _ONE
            grads["word_out"][k] += hk.T @ words
            grads["word_bias"][k] += words.sum(0)
            back[rows] += words @ p["word_out"][k].T
    return log, back


def backward(p: dict[str, np.ndarray], symbols: np.ndarray, fresh: np.ndarray, states: np.ndarray, gates: np.ndarray, news: np.ndarray, by_state: np.ndarray, grads: dict[str, np.ndarray]) -> None:
    """Truncated backpropagation through the window; by_state[t] is the loss's gradient by states[t + 1]."""
    steps, lanes = symbols.shape
    by_given = np.empty((steps, lanes, 3 * STATE), np.float32)
    carried = np.zeros((lanes, STATE), np.float32)
    recur, recur_new = p["recur"].T.copy(), p["recur_new"].T.copy()
    any_fresh = fresh.any(1)
    befores = states[:-1] * (~fresh).astype(np.float32)[:, :, None]
    for t in range(steps - 1, -1, -1):
        carried += by_state[t]
        before, z, new = befores[t], gates[t], news[t]
        update, reset = z[:, :STATE], z[:, STATE:]
        by_new = carried * update
        by_new *= _ONE - new * new
        by_given[t, :, 2 * STATE :] = by_new
        by_update = carried * (new - before)
        by_update *= update * (_ONE - update)
        by_reset_state = by_new @ recur_new
        by_reset = by_reset_state * before
        by_reset *= reset * (_ONE - reset)
        by_given[t, :, :STATE], by_given[t, :, STATE : 2 * STATE] = by_update, by_reset
        carried *= _ONE - update
        carried += by_reset_state * reset
        carried += by_given[t, :, : 2 * STATE] @ recur
        if any_fresh[t]:
            carried[fresh[t]] = 0
    flat_before = befores.reshape(-1, STATE)
    flat = by_given.reshape(-1, 3 * STATE)
    grads["recur"] += flat_before.T @ flat[:, : 2 * STATE]
    grads["recur_new"] += (gates[:, :, STATE:].reshape(-1, STATE) * flat_before).T @ flat[:, 2 * STATE :]
    grads["gates"] += flat.sum(0)
    order = np.argsort(symbols.ravel().astype(np.int16), kind="stable")
    own = symbols.ravel()[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    grads["inputs"][own[at]] += np.add.reduceat(flat[order], at, axis=0)


class Trainer:
    """Adam steps on windows of lanes of text, from given parameters."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.first = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.second = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.steps = self.tokens = 0

    def learn(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        """Learn texts, given one after another; lanes are equal stretches of them, and each symbol is predicted once."""
        n = len(symbols)
        inputs = np.empty(n, np.int64)
        inputs[1:] = symbols[:-1]
        starts = np.cumsum(sizes) - sizes
        inputs[starts] = TOP + BANDS
        fresh = np.zeros(n, bool)
        fresh[starts] = True
        lanes = min(LANES, n)
        steps = -(-n // lanes)
        pad = lanes * steps - n
        shaped = lambda x, fill: np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(lanes, steps).T
        inputs, fresh, targets = shaped(inputs, TOP + BANDS), shaped(fresh, True), shaped(symbols, -1)
        state = np.zeros((lanes, STATE), np.float32)
        for t in range(0, steps, WINDOW):
            state = self._step(np.ascontiguousarray(inputs[t : t + WINDOW]), np.ascontiguousarray(fresh[t : t + WINDOW]), targets[t : t + WINDOW], state)
        self.tokens += n

    def _step(self, inputs: np.ndarray, fresh: np.ndarray, targets: np.ndarray, state: np.ndarray) -> np.ndarray:
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        states, gates, news = forward(self.p, inputs, state, fresh)
        flat, wanted = states[1:].reshape(-1, STATE), targets.ravel()
        real = np.flatnonzero(wanted >= 0)
        if len(real):
            by = np.zeros_like(flat)
            by[real] = outputs(self.p, flat[real], wanted[real], grads)[1]
            backward(self.p, inputs, fresh, states, gates, news, by.reshape(states[1:].shape), grads)
            self._adam(grads, len(real))
        return states[-1]

    def _adam(self, grads: dict[str, np.ndarray], n: int) -> None:
        self.steps += 1
        rate = np.float32(RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        for k, g in grads.items():
            g *= np.float32(1 / n)
            self.first[k] += np.float32(0.1) * (g - self.first[k])
            self.second[k] += np.float32(0.01) * (g * g - self.second[k])
            self.p[k] -= rate * self.first[k] / (np.sqrt(self.second[k]) + np.float32(1e-8))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(rows: DataFrame, table: Counts, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after training on every row of (k2, symbols); the driver holds one set of parameters and sums of them from 32 tasks."""
    spark = rows.sparkSession
    p = initial(table)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, held, sizes = Trainer(shared.value), [], []
            for batch in batches:
                symbols, n = as_trained(batch.column(0).flatten().to_numpy()), batch.column(0).value_lengths().to_numpy()
                held.append(symbols.astype(np.int64))
                sizes.append(n.astype(np.int64))
                if sum(map(len, held)) >= LANES * WINDOW * 64:
                    trainer.learn(np.concatenate(held), np.concatenate(sizes))
                    held, sizes = [], []
            if sum(map(len, held)):
                trainer.learn(np.concatenate(held), np.concatenate(sizes))
            yield _sums(trainer.tokens, _flat(trainer.p).astype(float) * trainer.tokens)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(_flat(shared.value).size)
            for batch in batches:
                for tokens, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n += tokens
                    total += np.frombuffer(weights)
            yield _sums(n, total)

        own = rows.where(F.pmod(F.xxhash64("k2"), F.lit(rounds)) == k).select("symbols")
        parts = own.mapInArrow(learned, "tokens long, weights binary").repartition(32).mapInArrow(summed, "tokens long, weights binary").where("tokens > 0").toPandas()
        tokens = int(parts["tokens"].sum())
        if tokens:
            p = _unflat(sum(np.frombuffer(x) for x in parts["weights"]) / tokens, p)
    return p


def _sums(n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["tokens", "weights"])


def base_log(counts: np.ndarray, table: Counts) -> np.ndarray:
    return np.log10((counts + 0.5) / (table.tokens + 0.5 * (table.types + 1)))


def in_band_log(counts: np.ndarray, table: Counts) -> np.ndarray:
    """Log10 of a word's share of its band; the unknown type has its class to itself."""
    bands = np.maximum(table.band_counts[band_of(counts)], 1)
    return np.where(counts > 0, np.log10(np.maximum(counts, 1) / bands), 0.0)


def read_symbols(docs: DataFrame, counts: DataFrame, table: Counts) -> DataFrame:
    """(doc_id, held_out, k2, symbols, n_tokens, n_known, base_score, in_bands): every text as symbols, with what needs the words' counts.

    Words beyond the broadcast table are joined to their counts, once for each text they stand in; no text is shuffled, only symbols.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    id_type = dict(docs.dtypes)["doc_id"]

    def first(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for part in ta.chunks(batch, limit=CHUNK_BYTES):
            hashes, n = tokens_of(part.column(4))
            c, ranks = looked_up(t, hashes)
            doc = np.repeat(np.arange(len(n)), n)
            known = c >= 0
            symbols = np.where(known, symbols_of(c, ranks), -1).astype(np.int16)
            beyond = ~known
            sums = lambda x: pa.array(np.bincount(doc[known], x, len(n)).astype(float))
            in_band = np.where(ranks[known] < TOP, 0.0, in_band_log(c[known], t))
            lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            columns = [*part.columns[:4], lists(symbols, n), lists(hashes[beyond].view(np.int64), np.bincount(doc[beyond], minlength=len(n))), pa.array(np.bincount(doc[known], minlength=len(n))), sums(base_log(c[known], t)), sums(in_band)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "k1", "k2", "symbols", "beyond", "n_known", "base_score", "in_bands"])

    schema = f"doc_id {id_type}, held_out boolean, k1 long, k2 long, symbols array<short>, beyond array<long>, n_known long, base_score double, in_bands double"
    rows = grouping.cut(grouping.map_arrow(docs.select("doc_id", "held_out", "k1", "k2", "text"), first, schema))
    tails = rows.select("k1", "k2", F.explode(F.array_distinct("beyond")).alias("word")).distinct() if table.types > len(table.keys) else None
    if tails is None:
        met = rows.withColumn("met", F.expr("cast(array() as array<struct<word:long,n:long>>)"))
    else:
        found = tails.join(counts, "word").groupBy("k1", "k2").agg(F.collect_list(F.struct("word", "n")).alias("met"))
        met = rows.join(found, ["k1", "k2"], "left").withColumn("met", F.coalesce("met", F.expr("cast(array() as array<struct<word:long,n:long>>)")))

    def second(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            n = part.column(3).value_lengths().to_numpy().astype(np.int64)
            symbols = part.column(3).flatten().to_numpy().copy()
            sizes, met_sizes = part.column(4).value_lengths().to_numpy(), part.column(8).value_lengths().to_numpy()
            words, met = part.column(4).flatten().to_numpy().view(np.uint64), part.column(8).flatten()
            c = np.zeros(len(words), np.int64)
            doc, met_doc = np.repeat(np.arange(len(n)), sizes), np.repeat(np.arange(len(n)), met_sizes)
            if len(met):
                salt = lambda w, d: ta.mix(w ^ ta.mix(d.astype(np.uint64)))
                keys = salt(met.field(0).to_numpy().view(np.uint64), met_doc)
                order = np.argsort(keys)
                place = np.minimum(np.searchsorted(keys[order], own := salt(words, doc)), len(keys) - 1)
                c = np.where(keys[order][place] == own, met.field(1).to_numpy()[order][place], 0)
            symbols[symbols < 0] = symbols_of(c, np.full(len(c), -1))
            add = lambda i, x: pa.array(part.column(i).to_numpy() + np.bincount(doc, x, len(n)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(symbols))
            columns = [part.column(0), part.column(1), part.column(2), lists, pa.array(n), pa.array((part.column(5).to_numpy() + np.bincount(doc, c > 0, len(n))).astype(np.int64)), add(6, base_log(c, t)), add(7, in_band_log(c, t))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "k2", "symbols", "n_tokens", "n_known", "base_score", "in_bands"])

    met = met.select("doc_id", "held_out", "k2", "symbols", "beyond", "n_known", "base_score", "in_bands", "met")
    return grouping.cut(grouping.map_arrow(met, second, f"doc_id {id_type}, held_out boolean, k2 long, symbols array<short>, n_tokens long, n_known long, base_score double, in_bands double"))


def log_probabilities(p: dict[str, np.ndarray], symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log10 probability of each text (of one symbol at least): lanes of whole texts, the state carried across windows."""
    lanes = int(np.clip(sizes.sum() // max(int(sizes.max()), 1), 1, SCORE_LANES))
    ends = [(0, k) for k in range(lanes)]
    lane, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():  # the longest first, each into the shortest lane
        at[i], lane[i] = ends[0]
        heapq.heapreplace(ends, (int(at[i] + sizes[i]), int(lane[i])))
    steps = max(e for e, _ in ends)
    inputs, targets = np.full((steps, lanes), TOP + BANDS, np.int64), np.full((steps, lanes), -1, np.int64)
    fresh, text = np.zeros((steps, lanes), bool), np.zeros((steps, lanes), np.int64)
    time, of, first = _ranges(at, sizes), np.repeat(lane, sizes), np.cumsum(sizes) - sizes
    before = np.empty(len(symbols), np.int64)
    before[1:] = symbols[:-1]
    before[first] = TOP + BANDS
    inputs[time, of], targets[time, of], text[time, of] = before, symbols, np.repeat(np.arange(len(sizes)), sizes)
    fresh[at, lane] = True
    state, out = np.zeros((lanes, STATE), np.float32), np.zeros(len(sizes))
    for t in range(0, steps, SCORE_WINDOW):
        states, _, _ = forward(p, inputs[t : t + SCORE_WINDOW], state, fresh[t : t + SCORE_WINDOW])
        state = states[-1]
        wanted = targets[t : t + SCORE_WINDOW].ravel()
        real = np.flatnonzero(wanted >= 0)
        if len(real):
            log, _ = outputs(p, states[1:].reshape(-1, STATE)[real], wanted[real])
            out += np.bincount(text[t : t + SCORE_WINDOW].ravel()[real], log, len(out))
    return out / np.log(10.0)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out: str = "held_out", table_words: int = TABLE_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learning from those that aren't held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(held_out).alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("doc_id"), "k2": F.xxhash64("text")})
    counts = grouping.cut(count_words(rows.where("not held_out")))
    table = gather_counts(counts, table_words)
    read = read_symbols(rows, counts, table)
    shared = spark.sparkContext.broadcast(train(read.where("not held_out").select("k2", "symbols"), table, rounds))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def rows_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            symbols = np.concatenate([as_scored(b.column(1).flatten().to_numpy()) for b in held]).astype(np.int64)
            sizes = np.concatenate([b.column(1).value_lengths().to_numpy() for b in held]).astype(np.int64)
            logs, at = log_probabilities(shared.value, symbols, sizes), 0
            for b in held:
                own = pa.array(logs[at : at + b.num_rows] + b.column(2).to_numpy())
                at += b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[3:], own], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                held.append(part)
                size += len(part.column(1).flatten())
                if size > 1_000_000:
                    yield from rows_of(held)
                    held, size = [], 0
        if held:
            yield from rows_of(held)

    out = read.select("doc_id", "symbols", "in_bands", "held_out", "n_tokens", "n_known", "base_score")
    out = out.mapInArrow(scored, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(table.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs.withColumn("held_out", F.coalesce(crc_remainder("doc_id", 5) == 1, F.lit(True))))
