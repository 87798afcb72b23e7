"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all labelled rows in parallel (each task sums its rows, Spark sums the tasks); the log-probability
matrix has `buckets` rows and one column a language, so its size is fixed whatever the input, and it is broadcast. Scoring is a
narrow map: each chunk's n-grams are looked up as sparse rows of the matrix and summed by document.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every row if nothing could be learned. Rows with a
null language or text are not learned from. Ties go to the language that sorts first. Other columns are left as they are;
those of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: More languages than this are refused: the matrix is broadcast.
MAX_LANGUAGES = 1024


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def ngram_buckets(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram of the lower-cased texts, and each text's first one (with a last entry)."""
    texts = pc.utf8_lower(column.fill_null("")).to_pylist()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offs))
    found, owners = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        rolling = rolling[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if not len(rolling):
            break
        if n in ORDERS:
            whole = doc[: len(rolling)] == doc[n - 1 :]
            found.append(((rolling * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64)[whole] % buckets)
            owners.append(doc[: len(rolling)][whole])
    return (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _count(languages: list[str], buckets: int):
    index = {x: i for i, x in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * buckets, np.int64)
        for batch in ta.text_batches(batches):
            at, doc = ngram_buckets(batch.column(0), buckets)
            of = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            total += np.bincount(of[doc] * buckets + at, minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return counted


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> LanguageModel:
    """A model of all rows that have a text and a language."""
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    seen = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect())
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = [x for x, _ in seen]
    if not names:
        return LanguageModel([], np.zeros(0), np.zeros((buckets, 0), np.float32))
    cells = rows.mapInArrow(_count(names, buckets), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(names) * buckets)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    counts = counts.reshape(len(names), buckets)
    log = np.log((counts + smoothing) / (counts.sum(1, keepdims=True) + smoothing * buckets))
    share = np.array([n for _, n in seen], float)
    return LanguageModel(names, np.log(share / share.sum()), np.ascontiguousarray(log.T.astype(np.float32)))


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs, with the predicted language and its posterior probability; columns of these names are replaced."""
    shared = spark.sparkContext.broadcast(model)
    own = ta.own_column(docs, "text_to_score")
    docs = docs.withColumn(own, F.col(text).cast("string")).drop(pred, score)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in ta.text_batches(batches, own):
            column = batch.column(batch.num_columns - 1)
            best, top = np.full(len(column), len(names) - 1), np.zeros(len(column))
            if m.languages and len(column):
                at, doc = ngram_buckets(column, len(m.matrix))
                sums = np.stack([np.bincount(doc, m.matrix[at, k], len(column)) for k in range(len(m.languages))], 1) + m.prior
                has = pc.match_substring_regex(column.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
                likely = np.exp(sums - sums.max(1, keepdims=True))
                likely /= likely.sum(1, keepdims=True)
                best = np.where(has, sums.argmax(1), best)
                top = np.where(has, likely.max(1), 0.0)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best].tolist(), pa.string()), pa.array(top)], [*batch.schema.names[:-1], pred, score])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != own), f"`{pred}` string", f"`{score}` double"])
    return docs.mapInArrow(scored, schema)


def crc_remainder(doc_id: str, n: int):
    """crc32 of the id's text, modulo n; a null id has a null remainder and is never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(True)))
    model = fit(docs.where("not held_out"))
    return predict(spark, docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
