"""The income calendar: which salaries, bonuses and stock proceeds a ledger leads one to expect, which came, and what to review.

income has id, txn_date, amount, category and subcategory; a ledger's dates tell which months are closed. Events are month, event_type,
expected_date, expected_amount and tolerance (null where any amount will do).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import upper_medians

MONEY = "decimal(18,2)"
STOCK_MATERIALITY = 1000.0


def closed_month(ledger: DataFrame, closing_day: int = 28) -> DataFrame:
    """One row (first, latest, last): the ledger's first and latest day, and the first of the last month that it has in full."""
    days = ledger.agg(F.min("txn_date").alias("first"), F.max("txn_date").alias("latest"))
    last = F.when(F.dayofmonth("latest") >= closing_day, F.trunc("latest", "month")).otherwise(F.add_months(F.trunc("latest", "month"), -1))
    return days.withColumn("last", last)


def pay_day(month: Column) -> Column:
    """The day a salary is expected: the 25th, or the working day beside it; the 21st in December."""
    day = F.date_add(month, 24)
    return F.when(F.month(month) == 12, F.date_add(month, 20)).when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def _of(income: DataFrame, category: str, subcategory: str) -> DataFrame:
    return income.where((F.col("category") == category) & (F.col("subcategory") == subcategory) & (F.col("amount") > 0))


def _event(kind: str, month: Column, date: Column, amount: Column, tolerance: Column) -> list[Column]:
    return [F.date_format(month, "yyyy-MM").alias("month"), F.lit(kind).alias("event_type"), date.alias("expected_date"), amount.cast(MONEY).alias("expected_amount"), tolerance.cast("double").alias("tolerance")]


def expected_salaries(income: DataFrame, ledger: DataFrame, first_month: str = "2022-01", skipped_since: int = 2023, least: float = 750.0, share: float = 0.18) -> DataFrame:
    """A salary for each month from the first with one to the last closed one; Februaries are skipped from a year on, as bonuses hide them.

    The expected amount is the upper median of the months' totals, Februaries left out; two of these are needed.
    """
    totals = _of(income, "Income", "Salary").groupBy(F.trunc("txn_date", "month").alias("month")).agg(F.sum("amount").cast(MONEY).alias("total"))
    start = F.to_date(F.lit(f"{first_month}-01"))
    regular = totals.where((F.col("month") >= start) & (F.month("month") != 2)).withColumn("all", F.lit(1))
    enough = regular.groupBy("all").agg(F.count("*").alias("n")).where("n >= 2")
    expected = upper_medians(regular, ["all"], "total", "expected").join(enough.select("all"), "all")
    begin = totals.agg(F.greatest(F.min("month"), start).alias("begin"))
    one = expected.crossJoin(F.broadcast(begin)).crossJoin(F.broadcast(closed_month(ledger))).where("begin <= last")  # one row each
    months = one.select("expected", F.explode(F.sequence("begin", "last", F.expr("interval 1 month"))).alias("at")).where(~((F.month("at") == 2) & (F.year("at") >= skipped_since)))
    return months.select(*_event("salary", F.col("at"), pay_day(F.col("at")), F.col("expected"), F.greatest(F.lit(least), F.col("expected").cast("double") * share)))


def expected_bonuses(income: DataFrame, ledger: DataFrame, first_year: int = 2023, least: float = 5000.0, share: float = 0.25) -> DataFrame:
    """A bonus for each closed February from the first one with a bonus on."""
    rows = _of(income, "Income", "Cash Bonus").where((F.month("txn_date") == 2) & (F.year("txn_date") >= first_year)).withColumn("all", F.lit(1))
    begin = rows.groupBy("all").agg(F.min(F.year("txn_date")).alias("begin"))
    one = upper_medians(rows, ["all"], "amount", "expected").join(begin, "all").crossJoin(F.broadcast(closed_month(ledger))).where(F.col("begin") <= F.year("last"))
    years = one.select("expected", "last", F.explode(F.sequence("begin", F.year("last"))).alias("year")).withColumn("at", F.make_date("year", F.lit(2), F.lit(1))).where("at <= last")
    return years.select(*_event("cash_bonus", F.col("at"), pay_day(F.col("at")), F.col("expected"), F.greatest(F.lit(least), F.col("expected").cast("double") * share)))


def expected_stock(income: DataFrame, ledger: DataFrame, first_year: int = 2022) -> DataFrame:
    """Stock proceeds of any amount for each year that reaches the end of April, if there ever were some."""
    ever = _of(income, "Equity Compensation", "RSU").agg(F.count("*").alias("n")).where("n > 0")
    one = closed_month(ledger).crossJoin(F.broadcast(ever)).withColumn("begin", F.greatest(F.lit(first_year), F.year("first"))).where(F.col("begin") <= F.year("latest"))
    years = one.select("latest", F.explode(F.sequence("begin", F.year("latest"))).alias("year")).where(F.col("latest") >= F.make_date("year", F.lit(4), F.lit(30)))
    at = F.make_date("year", F.lit(4), F.lit(1))
    return years.select(*_event("rsu", at, F.date_add(at, 14), F.lit(None), F.lit(None)))


def observed(events: DataFrame, income: DataFrame, late_stock_year: int = 2022) -> DataFrame:
    """Events with status (observed or expected) and the transaction that shows them.

    A salary is observed if its month's total and the tolerance reach what was expected; a bonus if one of its month is within the tolerance; stock
    proceeds if some came from March to mid-May, or up to the end of one late year.
    """
    kind = F.when((F.col("category") == "Income") & (F.col("subcategory") == "Salary"), "salary").when((F.col("category") == "Income") & (F.col("subcategory") == "Cash Bonus"), "cash_bonus").when((F.col("category") == "Equity Compensation") & (F.col("subcategory") == "RSU"), "rsu")
    rows = income.where("amount > 0").select("id", "txn_date", "amount", kind.alias("event_type")).where("event_type is not null")
    by_month = rows.where("event_type <> 'rsu'").withColumn("month", F.date_format("txn_date", "yyyy-MM"))
    stock = rows.where((F.col("event_type") == "rsu") & (F.month("txn_date") >= 3)).where((F.month("txn_date") < 5) | ((F.month("txn_date") == 5) & (F.dayofmonth("txn_date") <= 15)) | (F.year("txn_date") == late_stock_year))
    stock = stock.withColumn("month", F.concat(F.year("txn_date"), F.lit("-04")))
    met = events.join(by_month.unionByName(stock), ["month", "event_type"])
    near = F.col("expected_amount").isNull() | (F.col("event_type") == "salary") | (F.abs(F.col("amount") - F.col("expected_amount")).cast("double") <= F.col("tolerance"))
    best = F.when(F.col("event_type") == "rsu", F.struct((-F.col("amount")).cast("double").alias("order"), "id")).when(F.col("event_type") == "salary", F.struct((-F.col("id")).cast("double").alias("order"), "id")).otherwise(F.struct(F.abs(F.datediff("txn_date", "expected_date")).cast("double").alias("order"), "id"))
    found = met.where(near).groupBy("month", "event_type").agg(F.sum("amount").cast("double").alias("total"), F.min(best).alias("best"))
    both = events.join(found, ["month", "event_type"], "left")
    enough = F.col("best").isNotNull() & ((F.col("event_type") != "salary") | (F.col("total") + F.col("tolerance") >= F.col("expected_amount").cast("double")))
    return both.select("month", "event_type", "expected_date", "expected_amount", "tolerance", F.when(enough, "observed").otherwise("expected").alias("status"), F.when(enough, F.col("best.id")).alias("transaction_id"))


def missing_income(events: DataFrame) -> DataFrame:
    """A review item for each event that didn't come; its materiality is the expected amount."""
    materiality = F.when(F.col("expected_amount").isNotNull(), F.abs("expected_amount").cast("double")).when(F.col("event_type") == "rsu", STOCK_MATERIALITY).otherwise(1.0)
    return events.where("status = 'expected'").select(F.lit("missing_income_event").alias("issue_type"), "month", "event_type", "expected_date", "expected_amount", materiality.alias("materiality"))
