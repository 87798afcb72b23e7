"""Filter interaction audit: what each of five filters removes, repeats and loses in every order they could run in.

Each document's text gives five flags. The rows of flags, without their texts, are crossed with the orders of the filters, a broadcast table of 5! = 120 rows
at every size of the corpus; each such row is exploded into its five steps; the least place of a failing filter is the step that removes the
document; sums of conditions by part, order and step follow, combined in each task before the shuffle, so a task sends at most 600 rows a part.

A filter's condition may need the whole table: a text repeats another if a smaller id has the same text. Texts are compared by their SHA-256;
the least id of each is found by partial aggregation and joined back, hot texts by broadcast (`grouping.join_few`), so no task holds the copies of a text.

Defined cases: a null text is an empty one; it fails A (under 200 words), and not B, C or D. A row without an id repeats nothing and no
row repeats it. Rows of equal id and text don't repeat each other. A null source is the empty one. Labels of one id count if any row has
them; a document without labels loses nothing. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping

#: Words end at these characters.
SPACES = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = r"[#$%&*|]"
FILTERS = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails each of the filters that look at it alone; every count is over the whole text."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.char_length(text),
        "D": text.rlike(SYMBOLS),
    }


def repeated(rows: DataFrame, doc_id: str = "doc_id", digest: str = "digest", name: str = "E") -> DataFrame:
    """rows, which have a digest of their text, with whether a smaller id has the same one; the digest is dropped."""
    rows = grouping.cut(rows)  # the digests are made once, for the counts and for the join
    firsts = grouping.cut(rows.groupBy(digest).agg(F.min(doc_id).alias("first_id"), F.count("*").alias("n_rows")))
    marked = grouping.join_few(rows, firsts, digest, "n_rows", rows.count())
    return marked.withColumn(name, F.coalesce(F.col(doc_id) > F.col("first_id"), F.lit(False))).drop(digest, "first_id")


def replay(flags: DataFrame, filters: str = FILTERS, part: str = "part", lost: tuple[str, ...] = ()) -> DataFrame:
    """One row a part, order and step: kept, removed, redundant, unique_fails, <x>_lost for each lost column x, and shapley.

    flags has a boolean column for each filter (a letter), true where a row fails it, the part and boolean columns of what is lost.
    """
    n, places = len(filters), [f"place_{i}" for i in range(1, len(filters) + 1)]
    rows = [("".join(p), *[1 << filters.index(x) for x in p]) for p in permutations(filters)]
    orders = flags.sparkSession.createDataFrame(rows, "filter_order string, " + ", ".join(f"{p} int" for p in places))
    fails = sum((F.when(F.col(x), 1 << i).otherwise(0) for i, x in enumerate(filters)), F.lit(0)).cast("int")
    crossed = flags.select(F.col(part).alias("part"), fails.alias("fails"), *lost).crossJoin(F.broadcast(orders))
    failing = lambda bit: F.col("fails").bitwiseAND(F.col(bit)) != 0
    first = F.coalesce(*[F.when(failing(p), i) for i, p in enumerate(places, 1)], F.lit(n + 1))
    steps = crossed.select("part", "filter_order", *lost, "fails", first.alias("first_fail"), F.posexplode(F.array(*places)).alias("place", "own"))
    at, fails_own = F.col("place") + 1, failing("own")
    removed = F.col("first_fail") == at
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    result = steps.groupBy("part", "filter_order", at.cast("int").alias("step")).agg(
        count(F.col("first_fail") > at, "kept"),
        count(removed, "removed"),
        count(fails_own & (F.col("first_fail") < at), "redundant"),
        count(F.col("fails") == F.col("own"), "unique_fails"),
        *[count(removed & F.col(x), f"{x}_lost") for x in lost],
    )
    return _with_shares(result)


def _with_shares(result: DataFrame) -> DataFrame:
    """With shapley: what the step's filter removes, summed over all orders. A part has 600 rows here, so the join is small and has no hot key."""
    result = grouping.cut(result)
    own = F.substring("filter_order", F.col("step"), F.lit(1))
    shares = result.groupBy("part", own.alias("own")).agg(F.sum("removed").alias("shapley"))
    return result.withColumn("own", own).join(shares, ["part", "own"]).drop("own")


def document_flags(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, A to E, good, toxic): one row a document, without its text."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    flagged = body.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), *[c.alias(x) for x, c in text_flags(F.col("body")).items()])
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = repeated(flagged).join(marks, "doc_id", "left")
    return joined.select("part", *FILTERS, *[F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    return replay(document_flags(docs, labels), lost=("good", "toxic"))


OP12_SQL = r"""
WITH body AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
split AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM body),
firsts AS (SELECT body, min(doc_id) AS first_id FROM body GROUP BY body),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT s.part,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(s.body, '[^A-Z]+', '', 'g')) > 2 * length(s.body) AS c,
         regexp_matches(s.body, '[#$%&*|]') AS d,
         coalesce(s.doc_id > f.first_id, false) AS e,
         coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
  FROM split s JOIN firsts f ON f.body = s.body LEFT JOIN marks m ON m.doc_id = s.doc_id),
failed AS (
  SELECT row_number() OVER () AS id, part, good, toxic, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f FROM flags),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order
  FROM letters l1, letters l2, letters l3, letters l4, letters l5
  WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
steps AS (SELECT filter_order, s AS step, filter_order[s] AS own FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
each_filter AS (
  SELECT id, part, good, toxic, n_fails, x, CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS fails
  FROM failed, letters),
firsts_of AS (
  SELECT e.id, s.filter_order, min(CASE WHEN e.fails THEN s.step ELSE 6 END) AS first_fail
  FROM each_filter e JOIN steps s ON s.own = e.x GROUP BY ALL),
counts AS (
  SELECT e.part, s.filter_order, s.step, s.own,
         count(*) FILTER (o.first_fail > s.step) AS kept, count(*) FILTER (o.first_fail = s.step) AS removed,
         count(*) FILTER (e.fails AND o.first_fail < s.step) AS redundant, count(*) FILTER (e.fails AND e.n_fails = 1) AS unique_fails,
         count(*) FILTER (o.first_fail = s.step AND e.good) AS good_lost, count(*) FILTER (o.first_fail = s.step AND e.toxic) AS toxic_lost
  FROM each_filter e JOIN steps s ON s.own = e.x JOIN firsts_of o ON o.id = e.id AND o.filter_order = s.filter_order
  GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
"""
