"""Queries of holiday trips and of the whole cascade with all facts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, trips
from .cascade_queries import _LEDGER, bank_ledger
from .ledger_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: What a row says of where it was paid, by its key modulo the number of these.
PLACES = (
    "PAYMENT TERMINAL ESP CALA", "TICKETS IN ITALY", "PAYMENT TERMINAL NULL CALA", "CARD SEQUENCE 2 PALMA", "PAYMENT TERMINAL NLD LISSE", "PAYMENT TERMINAL BREDA", "BOL.COM KAARTNUMMER 1", "NOTHING", "PAYMENT TERMINAL SPAIN GRC", "KAARTNUMMER SAVINGS", "SPAINISH", "PAYMENT TERMINAL CASH WITHDRAWAL"
)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.element_at(F.array(*[F.lit(x) for x in PLACES]), (F.col("id") % len(PLACES) + 1).cast("int"))
    return bank_ledger(spark, sf_dir).withColumn("description", place)


_TRIPS = (
    _LEDGER
    + f""", s AS (SELECT id, d, [{", ".join(f"'{x}'" for x in PLACES)}][id % {len(PLACES)} + 1] AS said FROM l WHERE NOT is_duplicate AND amount < 0),
r AS (SELECT id, d, CASE WHEN said LIKE '%ESP%' THEN 'Spain' WHEN said LIKE '%GRC%' THEN 'Greece' WHEN said LIKE '%ITALY%' THEN 'Italy' END AS country,
 said IN ('PAYMENT TERMINAL ESP CALA', 'PAYMENT TERMINAL NULL CALA', 'CARD SEQUENCE 2 PALMA', 'PAYMENT TERMINAL SPAIN GRC') AS absorbable FROM s),
q AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER w, d) <= 5 THEN 0 ELSE 1 END AS new FROM r WHERE country IS NOT NULL AND month(d) BETWEEN 6 AND 9 WINDOW w AS (PARTITION BY country ORDER BY d, id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY country ORDER BY d, id) AS run FROM q), t AS (SELECT country, min(d) AS first_day, max(d) AS last_day, count(*) AS n FROM i GROUP BY country, run HAVING count(*) >= 3)
"""
)
QUERIES["holiday_trips"] = lambda spark, sf_dir: plain(trips.trips(trips.seen(cascade.with_texts(_ledger(spark, sf_dir)))).select("country", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n"))
ORACLE_SQL["holiday_trips"] = _TRIPS + "SELECT country, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, n FROM t"
QUERIES["holiday_rows"] = lambda spark, sf_dir: plain(trips.holiday_rows(cascade.with_texts(_ledger(spark, sf_dir))))
ORACLE_SQL["holiday_rows"] = (
    _TRIPS
    + """, m AS (SELECT r.id, t.country, t.first_day, row_number() OVER (PARTITION BY r.id ORDER BY t.country, t.first_day) AS k FROM r JOIN t ON r.d BETWEEN t.first_day - 3 AND t.last_day + 3 AND (r.country = t.country OR r.absorbable))
SELECT id, country || ' ' || year(first_day) AS label FROM m WHERE k = 1"""
)
