"""Periods over monthly rows: all, last13, ytd, year:Y, years:a,b, lastNyears and a bare year; anything else is last13."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = "0000-00", "9999-99"


def filter_period(months: DataFrame, period: str, as_of: str | None = None) -> DataFrame:
    """The rows (one a month) of a period. last13 counts rows, not calendar months; lastNyears counts years that are there.

    as_of (yyyy-MM) gives the year of ytd; without it, the last month's.
    """
    year = F.substring("month", 1, 4)
    if period == "all":
        return months
    if found := re.fullmatch(r"last(\d+)years", period):
        years = months.select(year.alias("year")).distinct()
        chosen = years.orderBy(F.desc("year")).limit(int(found[1]))
        return months.join(F.broadcast(chosen), year == chosen["year"], "left_semi")
    if found := re.fullmatch(r"(?:year:)?(\d{4})", period):
        return months.where(year == found[1])
    if found := re.fullmatch(r"years:([\d,]+)", period):
        return months.where(year.isin(*filter(None, found[1].split(","))))
    if period == "ytd":
        if as_of is not None:
            return months.where(year == as_of[:4])
        last = months.agg(F.max(year).alias("last_year"))
        return months.join(F.broadcast(last), year == F.col("last_year"), "left_semi")
    last13 = months.select("month").orderBy(F.desc("month")).limit(13)
    return months.join(F.broadcast(last13), "month", "left_semi")


def bounds(months: DataFrame) -> DataFrame:
    """One row (first, last) that holds every month of a period and those between; sentinels for an empty one."""
    return months.agg(F.coalesce(F.min("month"), F.lit(FIRST)).alias("first"), F.coalesce(F.max("month"), F.lit(LAST)).alias("last"))


def within(ledger: DataFrame, limits: DataFrame) -> DataFrame:
    """The ledger's rows from the first to the last month."""
    month = F.date_format("txn_date", "yyyy-MM")
    return ledger.join(F.broadcast(limits), (month >= F.col("first")) & (month <= F.col("last"))).drop("first", "last")


def between(ledger: DataFrame, first: str, last: str) -> DataFrame:
    """The ledger's rows from the first to the last month, by literal dates that reach the scan; a sentinel leaves its end open."""
    if first != FIRST:
        ledger = ledger.where(F.col("txn_date") >= F.to_date(F.lit(f"{first}-01")))
    if last != LAST:
        ledger = ledger.where(F.col("txn_date") < F.add_months(F.to_date(F.lit(f"{last}-01")), 1))
    return ledger


def complete_months(months: DataFrame, as_of: str) -> DataFrame:
    """The months without the last one, if that is as_of and there are several."""
    w = Window.partitionBy()
    marked = months.withColumns({"__last": F.max("month").over(w), "__n": F.count("*").over(w)})
    return marked.where(~((F.col("month") == F.col("__last")) & (F.col("month") == as_of) & (F.col("__n") > 1))).drop("__last", "__n")
