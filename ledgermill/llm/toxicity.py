"""Toxicity by class-conditional Kneser-Ney models: the toxic and the ordinary model's log-likelihoods a token are compared.

Each class has an interpolated model of words after the word before (`ORDER` words). Pairs are counted by the class's documents they stand in, words by their
continuations: after how many different words they stand. The discount of each order and class is the usual n1 / (n1 + 2 n2) of its counts of counts, and what is
discounted goes to the next shorter history. The class is a part of the history that is dropped before the word is: the class's pairs
back off to the pairs of both classes, these to the class's words, these to the words of both, and these to all words alike. So every expression of the sample counts, single ones too.

Most words of a toxic text are those of any other. So its likelihood is that of a mixture: a token is the toxic model's with a small
probability, else the ordinary model's. The probability is, of `WEIGHTS`, the one by which the rows that are kept for the curve are told apart best. Without the
mixture the many rare words that only one class shows outweigh the few that make a text toxic (held-out AUC on sf0.1: 0.74).

The models are fitted on a bounded sample of labelled rows: at most `MAX_DOCS` rows and `MAX_CHARS` characters a class for the counts,
a third as many again, of other rows, to turn the difference of the mean log-likelihoods into a probability (a logistic curve of its inverse hyperbolic sine, as differences of toxic texts span
orders of magnitude; weighted to the share of toxic labels among all training labels). Rows are drawn by a hash of their id. The model's size is bounded by the sample, so it is broadcast;
scoring is a narrow map over whole texts.

Defined cases: null and wordless texts score as a text that says nothing (the curve at difference 0); rows without a label, text or id
are never learned from; several labels of one id count as one, toxic if any is. With labels of one class only or none, every score is 0. A
column of the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grouping
from . import textarrays as ta
from .language_id import crc_remainder

MAX_DOCS, MAX_CHARS = 6000, 24_000_000
ORDER = 2
#: Probabilities of the toxic model's tokens in toxic texts that are tried.
WEIGHTS = (0.1, 0.05, 0.02, 0.01, 0.005, 0.002)
#: Parts in which pairs come to the driver.
SLICES = 4
#: Of the gated form (`discounted`), which no query uses.
DEVIATIONS = 3.0
_START = np.uint64(0xA5A5A5A5A5A5A5A5)
CLASSES = ("ordinary", "toxic")


@dataclass(frozen=True)
class Expressions:
    """Of one order: sorted keys of expressions with what each class has beyond its discount, and sorted contexts with what each hands down.

    Excess is divided by the contexts' count and by the shared probability of the last word; a context that isn't here hands down all.
    """

    keys: np.ndarray
    excess: np.ndarray
    contexts: np.ndarray
    handed_down: np.ndarray


@dataclass(frozen=True)
class ToxicityModel:
    orders: tuple[Expressions, ...]  # three columns each: both classes, ordinary, toxic
    curve: tuple[float, float, float] | None  # scale of the difference, slope, offset
    words: int = 0
    weight: float = WEIGHTS[0]


def joined_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ta.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def expressions(column: pa.Array, order: int = ORDER) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For one word, two and so on up to the order: each token's context and key; and each text's first token. Starts count as words."""
    hashes, _, _, first = ta.words(*ta.packed(column, "utf8"))
    row_first = np.repeat(first[:-1], np.diff(first))
    at = np.arange(len(hashes))
    back = lambda j: np.where(at - j >= row_first, hashes[np.maximum(at - j, 0)], _START)
    found = [(np.zeros_like(hashes), hashes)]
    for n in range(2, order + 1):
        context = back(n - 1)
        for j in range(n - 2, 0, -1):
            context = joined_keys(context, back(j))
        found.append((context, joined_keys(context, hashes)))
    return found, first


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys among sorted keys, and whether each is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def relative_probabilities(model: ToxicityModel, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each token's probability in its context under the ordinary and the toxic model, one column each, over its shared probability."""
    out = np.ones((len(found[0][1]), 2))
    for table, (context, key) in zip(model.orders, found):
        at, has = _lookup(table.contexts, context)
        out[has] *= table.handed_down[at[has]]
        at, has = _lookup(table.keys, key)
        out[has] += table.excess[at[has]]
    return out


def probabilities(model: ToxicityModel, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each token's probability after its history under the ordinary and the toxic model, one column each."""
    out = np.full((len(found[0][1]), 2), 1.0 / (model.words + 1))  # one more: a word that isn't known
    for table, (context, key) in zip(model.orders, found):
        at, known = _lookup(table.contexts, context)
        handed = np.where(known[:, None], table.handed_down[at], 1.0) if len(table.contexts) else np.ones((len(out), 3))
        at, has = _lookup(table.keys, key)
        excess = np.where(has[:, None], table.excess[at], 0.0) if len(table.keys) else np.zeros((len(out), 3))
        out = out * handed[:, :1] + excess[:, :1]
        out = out * handed[:, 1:] + excess[:, 1:]
    return out


def differences(model: ToxicityModel, column: pa.Array, weights: tuple[float, ...] | None = None) -> np.ndarray:
    """Of each text, the toxic less the ordinary log-likelihood, divided by its number of words; 0 without words. With weights, a column for each."""
    found, first = expressions(column, len(model.orders))
    n = np.maximum(np.diff(first), 1)
    p = probabilities(model, found)
    ratio = p[:, 1] / p[:, 0]
    out = []
    for weight in weights or (model.weight,):
        sums = np.concatenate([[0.0], np.cumsum(np.log1p(weight * (ratio - 1.0)))])
        out.append((sums[first[1:]] - sums[first[:-1]]) / n)
    return np.stack(out, 1) if weights else out[0]


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, part) of the bounded sample, part 0 for counts and 1 for the curve, and the number of training labels by class.

    docs has doc_id, text, learn; a draw is the hash of the id.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(crc_remainder("doc_id", 5) != 0).withColumn("draw", F.xxhash64("doc_id"))
    totals = {int(r["toxic"]): r["n"] for r in marks.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = max_docs + max_docs // 3
    drawn = [marks.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(most) for k in (0, 1)]
    sample = drawn[0].union(drawn[1])  # no more than 8 / 3 * max_docs ids
    rows = docs.where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "toxic", "draw")
    rows = grouping.cut(rows.withColumn("n", F.char_length("text")))
    w = Window.partitionBy("toxic").orderBy("draw", F.xxhash64("text"))
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumns({"at": F.row_number().over(w), "run": run})
    part = F.when((F.col("at") % 4 != 0) & (F.col("run") <= max_chars * 4 / 3), 0).when(F.col("run") <= max_chars * 4 / 3, 1)
    return grouping.cut(ranked.withColumn("part", part).where("part is not null").select("text", "toxic", "part")), totals


def _counted(batch: pa.RecordBatch, n_words: int = ORDER) -> Iterator[pa.RecordBatch]:
    for part in ta.chunks(batch):
        found, first = expressions(part.column(0), n_words)
        toxic = part.column(1).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(part.num_rows), np.diff(first))
        for n, (context, key) in enumerate(found, 1):
            order = np.lexsort((doc, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order[1:]] != key[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            once = order[new]  # each expression once a document
            keys, at, which = np.unique(key[once], return_index=True, return_inverse=True)
            counts = [np.bincount(which, toxic[doc[once]] == k, len(keys)).astype(np.int64) for k in (0, 1)]
            taken = once[at]
            columns = [pa.array(np.full(len(keys), n, np.int32)), *(pa.array(x[taken].view(np.int64)) for x in (context, key, found[0][1])), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["n", "context", "key", "word", *CLASSES])


def discounted(grams: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """(n, context, key, word, excess_ordinary, excess_toxic): the gated form, the expressions of which a class has more than the shared counts explain.

    grams has (n, context, key, word) with the contexts of each class. Excess is a share of the context's count.
    """
    both = F.col("ordinary") + F.col("toxic")
    singles = grams.groupBy("n").agg((F.count_if(both == 1) / F.greatest(F.count_if(both == 1) + 2 * F.count_if(both == 2), F.lit(1))).alias("usual"))
    sums = grams.groupBy("n", "context").agg(*[F.sum(c).alias(f"all_{c}") for c in CLASSES])
    several = grams.where(both > 1).join(sums, ["n", "context"]).join(F.broadcast(singles), "n")  # no single count is beyond its discount
    everything = F.col("all_ordinary") + F.col("all_toxic")
    for c in CLASSES:
        expected = both * F.col(f"all_{c}") / everything
        beyond = F.col(c) - expected - F.lit(deviations) * F.sqrt(expected) - F.col("usual")
        several = several.withColumn(f"excess_{c}", F.greatest(beyond, F.lit(0.0)) / F.greatest(F.col(f"all_{c}"), F.lit(1)))
    return several.where("excess_ordinary > 0 or excess_toxic > 0").select("n", "context", "key", "word", "excess_ordinary", "excess_toxic")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> ToxicityModel | None:
    """A model of the bounded sample of the labelled rows of docs (doc_id, text) that crc32 leaves for training."""
    rows, totals = training_rows(docs, labels, max_docs, max_chars)
    if not totals.get(0) or not totals.get(1):
        return None
    counted = grouping.map_arrow(rows.where("part = 0").select("text", "toxic"), _counted, "n int, context long, key long, word long, ordinary long, toxic long")
    # Pairs by documents, no more rows than the sample has pairs of words, in slices of words; words by what stands before them. Arrays are let go once they
    # have served: the driver has one copy of the pairs, and one slice beside it.
    pairs, words = [[], [], [], []], [[], [], [], []]
    for i in range(SLICES):
        own = counted.where((F.col("n") == 2) & (F.pmod("word", F.lit(SLICES)) == i)).groupBy("context", "word").agg(*[F.sum(c).cast("int").alias(c) for c in CLASSES]).toArrow()
        context, word, *counts = (own.column(j).to_numpy() for j in range(4))
        context, word = context.view(np.uint64), word.view(np.uint64)
        known, which = np.unique(word, return_inverse=True)
        for out, x in zip(words, (known, np.bincount(which, minlength=len(known)), *(np.bincount(which[n > 0], minlength=len(known)) for n in counts))):
            out.append(x)
        for out, x in zip(pairs, (context, joined_keys(context, word), *counts)):
            out.append(x)
        del own, which
    known, *after = (np.concatenate(x) for x in words)
    columns = []
    while pairs:
        columns.append(np.concatenate(pairs.pop(0)))
    context, key, *counts = columns
    del columns
    orders = (smoothed(np.zeros_like(known), known, *after), smoothed(context, key, counts[0] + counts[1], *counts))
    del context, key, counts
    model = ToxicityModel(orders, None, len(orders[0].keys))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in ta.chunks(batch):
            x = differences(shared.value, part.column(0), WEIGHTS)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), part.column(1)], [*(f"x{i}" for i in range(len(WEIGHTS))), "toxic"])

    seen = grouping.map_arrow(rows.where("part = 1").select("text", "toxic"), measured, ", ".join([*(f"x{i} double" for i in range(len(WEIGHTS))), "toxic int"])).toPandas()
    shared.destroy()
    y = seen["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return replace(model, curve=(1.0, 10.0, 0.0))
    per_row = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    best = None
    for i, weight in enumerate(WEIGHTS):
        x = seen[f"x{i}"].to_numpy(float)
        scale = max(float(np.quantile(np.abs(x[y == 0]), 0.9)), 1e-6)
        z = np.arcsinh(x / scale)
        slope, offset = logistic(z, y, per_row / per_row.mean())
        loss = float((per_row * np.logaddexp(0.0, np.where(y == 1, -1.0, 1.0) * (slope * z + offset))).sum())
        if best is None or loss < best[0]:
            best = loss, weight, (scale, slope, offset)
    return replace(model, curve=best[2], weight=best[1])


def smoothed(context: np.ndarray, key: np.ndarray, *counts: np.ndarray) -> Expressions:
    """One order's expressions with what each column of counts (both classes, ordinary, toxic) has beyond its discount, as a share of the context's count."""
    order = np.argsort(key)
    contexts, which = np.unique(context[order], return_inverse=True)
    which = which.astype(np.int32)
    excess, handed = np.zeros((len(key), len(counts)), np.float32), np.ones((len(contexts), len(counts)), np.float32)
    for i, column in enumerate(counts):
        ones, twos = int((column == 1).sum()), int((column == 2).sum())
        discount = max(ones / max(ones + 2 * twos, 1), 1e-3)  # never 0, so that no word is impossible
        n = column[order]
        every = np.bincount(which, n, len(contexts))
        n = np.maximum(n - discount, 0.0)
        handed[:, i] = np.where(every > 0, 1.0 - np.bincount(which, n, len(contexts)) / np.maximum(every, 1), 1.0)
        n /= np.maximum(every, 1)[which]
        excess[:, i] = n
    return Expressions(key[order], excess, contexts, handed)


def _table(found) -> Expressions:
    """The expressions of one order, from a frame of what is beyond their discounts."""
    found = found.assign(**{x: found[x].to_numpy(np.int64).view(np.uint64) for x in ("context", "key")}).sort_values("key")
    excess = found[[f"excess_{c}" for c in CLASSES]].to_numpy(float).reshape(-1, 2)
    held = found.groupby("context")[[f"excess_{c}" for c in CLASSES]].sum()
    return Expressions(found["key"].to_numpy(np.uint64), excess / found["share"].to_numpy(float)[:, None], held.index.to_numpy(np.uint64), 1.0 - held.to_numpy(float).reshape(-1, 2))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression of one variable, by damped Newton steps with a slight ridge."""
    scale = max(float(x.std()), 1e-9)
    z = np.stack([x / scale, np.ones_like(x)], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-3 * theta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / scale), float(theta[1])


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs with the probability that a text is toxic; a column of that name is replaced."""
    value = F.col(text).cast("string")
    own = ta.own_column(docs, "text_to_score")
    docs = docs.withColumn(own, value).drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in ta.chunks(batch, own):
            out = np.zeros(part.num_rows)
            if m is not None:
                scale, slope, offset = m.curve
                out = 1 / (1 + np.exp(-np.clip(slope * np.arcsinh(differences(m, part.column(part.num_columns - 1)) / scale) + offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out)], [*part.schema.names[:-1], name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != own), f"`{name}` double"])
    return grouping.map_arrow(docs, scored, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    scored = score(docs.select("doc_id", held_out, "text"), fit(docs, labels))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
