"""Monthly figures of a ledger: class routing, FIFO clearing of reimbursements, amortisation, snapshot formulae and their roll-ups.

A ledger has txn_date, amount (decimal, inflow positive), economic_class, category, subcategory, is_duplicate; `entity` names columns that
part the ledger into households (none: one household). Months are `yyyy-MM`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BURN_CLASSES = ("household_spend", "debt_service")
#: Categories and subcategories that the measures name.
UNKNOWN_CARD_CATEGORY = "Unknown Card Spend"
VARIABLE_INCOME_CATEGORIES = ("Equity Compensation",)
VARIABLE_INCOME_SUBCATEGORIES = ("Cash Bonus", "RSU")
BUSINESS_CATEGORIES = ("Holiday", "Transportation", "Education")
BUSINESS_REIMBURSEMENTS = ("Company Expense", "Expense Offset", "Booking.com")
MONEY = "decimal(28,2)"
MEASURES = (
    "net_cash_change", "real_income", "regular_income", "variable_income", "household_spend", "mortgage_total",
    "wealth_allocation", "internal_transfers", "reimbursements_received", "refunds", "unknown_card_spend",
)


def active(ledger: DataFrame) -> DataFrame:
    return ledger.where(~F.col("is_duplicate"))


def month() -> Column:
    return F.date_format("txn_date", "yyyy-MM").alias("month")


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast(MONEY)


def _business(categories: tuple[str, ...], reimbursements: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether a row is an outflow that an employer may pay back, and whether it is an inflow that does."""
    spend = (F.col("amount") < 0) & (F.col("economic_class") == "household_spend") & F.col("category").isin(*categories)
    received = (F.col("amount") > 0) & (F.col("economic_class") == "reimbursement_pass_through") & F.col("subcategory").isin(*reimbursements)
    return spend, received


def _business_sums(spend: Column, received: Column) -> list[Column]:
    return [_sum(F.when(spend, -F.col("amount"))).alias("business_spend"), _sum(F.when(received, F.col("amount"))).alias("business_received")]


def aggregate_months(ledger: DataFrame, entity: tuple[str, ...] = (), business: tuple[Column, Column] | None = None) -> DataFrame:
    """One row a month with each class's amounts routed to its measures: one pass, partial sums before the shuffle.

    business: tests of business spend and of what is received for it; their sums are taken in the same pass.
    """
    amount, cls = F.col("amount"), F.col("economic_class")
    inflow, outflow = F.greatest(amount, F.lit(0)), F.abs(F.least(amount, F.lit(0)))
    variable = F.col("category").isin(*VARIABLE_INCOME_CATEGORIES) | F.col("subcategory").isin(*VARIABLE_INCOME_SUBCATEGORIES)
    variable = F.coalesce(variable, F.lit(False))
    of = lambda name, x: F.when(cls == name, x)
    return (
        active(ledger)
        .groupBy(*entity, month())
        .agg(
            _sum(amount).alias("net_cash_change"),
            _sum(of("income", inflow)).alias("real_income"),
            _sum(F.when((cls == "income") & ~variable, inflow)).alias("regular_income"),
            _sum(F.when((cls == "income") & variable, inflow)).alias("variable_income"),
            _sum(of("household_spend", outflow)).alias("household_spend"),
            _sum(of("debt_service", outflow)).alias("mortgage_total"),
            _sum(of("wealth_allocation", outflow)).alias("wealth_allocation"),
            _sum(of("internal_transfer", F.abs(amount))).alias("internal_transfers"),
            _sum(of("reimbursement_pass_through", inflow)).alias("reimbursements_received"),
            _sum(of("refund", inflow)).alias("refunds"),
            _sum(F.when((cls == "household_spend") & (F.col("category") == UNKNOWN_CARD_CATEGORY), outflow)).alias("unknown_card_spend"),
            *([] if business is None else _business_sums(*business)),
        )
    )


def linked_reimbursements(ledger: DataFrame, links: DataFrame, entity: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(month, cleared) by the outflow's month and (month, used) by the inflow's: links (outflow_id, inflow_id, amount) of expense reimbursements.

    Duplicates count here too, as the links name rows.
    """
    rows = ledger.select("id", "amount", month(), *entity)
    out = rows.select(F.col("id").alias("outflow_id"), F.abs("amount").alias("spent"), F.struct(*entity, "month").alias("out_key"))
    into = rows.select(F.col("id").alias("inflow_id"), F.struct(*entity, "month").alias("in_key"))
    met = links.join(out, "outflow_id").join(into, "inflow_id").select("out_key", "in_key", F.least("amount", "spent").alias("cleared"))
    sums = lambda key, name: met.groupBy(key).agg(_sum(F.col("cleared")).alias(name)).select(f"{key}.*", name)
    return sums("out_key", "cleared"), sums("in_key", "used")


def fifo_clearing(months: DataFrame, spend: str, received: str, used: str | None = None, entity: tuple[str, ...] = ()) -> DataFrame:
    """months with `cleared` (by the month of the spend) and `payback_used` (by the month of the reimbursement).

    A queue of spend, oldest first, that each month's reimbursements clear; what is left of them is not carried forward. With running sums
    S of spend and R of what is available, the sum cleared so far is R + min(0, least of S - R so far), which needs windows only. A
    household has a row a month, so a window is small; several households are parted by `entity`.
    """
    w = Window.partitionBy(*entity).orderBy("month")
    so_far, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*entity)
    free = F.greatest(F.col(received) - (F.col(used) if used else F.lit(0)), F.lit(0)).cast(MONEY)
    out = months.withColumns({"__s": F.sum(F.col(spend).cast(MONEY)).over(so_far), "__r": F.sum(free).over(so_far)})
    out = out.withColumn("__c", F.col("__r") + F.least(F.lit(0), F.min(F.col("__s") - F.col("__r")).over(so_far)))
    out = out.withColumn("payback_used", (F.col("__c") - F.coalesce(F.lag("__c").over(w), F.lit(0))).cast(MONEY))
    last = F.max("__c").over(whole)  # what is cleared never falls
    cleared = F.greatest(F.lit(0), F.least(F.col(spend), last - (F.col("__s") - F.col(spend))))
    return out.withColumn("cleared", cleared.cast(MONEY)).drop("__s", "__r", "__c")


def business_months(ledger: DataFrame, links: DataFrame | None = None, categories: tuple[str, ...] = BUSINESS_CATEGORIES, reimbursements: tuple[str, ...] = BUSINESS_REIMBURSEMENTS, entity: tuple[str, ...] = ()) -> DataFrame:
    """(month, business_spend, business_received): outflows that an employer may pay back and inflows that do, without linked rows."""
    spend, received = _business(categories, reimbursements)
    rows = active(ledger).where(spend | received)
    if links is not None:
        ends = links.select(F.explode(F.array("outflow_id", "inflow_id")).alias("id"))
        rows = rows.join(ends, "id", "left_anti")
    return rows.groupBy(*entity, month()).agg(*_business_sums(spend, received))


def amortization(rules: DataFrame, ledger: DataFrame, entity: tuple[str, ...] = ()) -> DataFrame:
    """(month, addition, replaced): rules (transaction_id, monthly_amount, start_month, end_month) spread over their months.

    An open end is eleven months after the start. Months beyond the ledger's appear too. A rule is of its row's household; with
    households, one whose row isn't in the ledger is of none and has no months.
    """
    rows = ledger.select(F.col("id").alias("transaction_id"), month(), F.abs("amount").alias("replaced"), *entity)
    spread = rules.join(rows.select("transaction_id", *entity), "transaction_id") if entity else rules
    start = F.to_date(F.concat("start_month", F.lit("-01")))
    end = F.coalesce(F.to_date(F.concat("end_month", F.lit("-01"))), F.add_months(start, 11))
    spread = spread.select(*entity, F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("day"), "monthly_amount")
    spread = spread.select(*entity, F.date_format("day", "yyyy-MM").alias("month"), F.col("monthly_amount").alias("addition"), F.lit(0).cast(MONEY).alias("replaced"))
    own = rows.join(rules.select("transaction_id"), "transaction_id").select(*entity, "month", F.lit(0).cast(MONEY).alias("addition"), "replaced")
    return spread.union(own).groupBy(*entity, "month").agg(_sum(F.col("addition")).alias("addition"), _sum(F.col("replaced")).alias("replaced"))


def snapshots(ledger: DataFrame, links: DataFrame | None = None, rules: DataFrame | None = None, entity: tuple[str, ...] = ()) -> DataFrame:
    """The monthly snapshot: linked clearing, then unknown card spend, then business expenses by FIFO, then amortisation.

    With columns of `entity`, each household has its own months. Without links the ledger is read once.
    """
    keys = [*entity, "month"]
    if links is None:
        months = aggregate_months(ledger, entity, _business(BUSINESS_CATEGORIES, BUSINESS_REIMBURSEMENTS)).withColumns({"cleared": F.lit(0), "used": F.lit(0)})
    else:
        cleared, used = linked_reimbursements(ledger, links, entity)
        months = aggregate_months(ledger, entity).join(business_months(ledger, links, entity=entity), keys, "left").join(cleared, keys, "left").join(used, keys, "left")
    zero = lambda *names: {c: F.coalesce(F.col(c), F.lit(0)).cast(MONEY) for c in names}
    months = months.withColumns(zero("cleared", "used", "business_spend", "business_received")).withColumnRenamed("cleared", "linked_cleared")
    months = fifo_clearing(months, "unknown_card_spend", "reimbursements_received", "used", entity)
    months = months.withColumn("used", F.col("used") + F.col("payback_used")).withColumnRenamed("cleared", "card_cleared").drop("payback_used")
    months = fifo_clearing(months, "business_spend", "business_received", "used", entity).withColumnRenamed("cleared", "business_cleared")
    if rules is not None:
        months = months.join(amortization(rules, ledger, entity), keys, "full_outer")
    else:
        months = months.withColumns({"addition": F.lit(0), "replaced": F.lit(0)})
    months = months.na.fill(0, [c for c in months.columns if c not in keys])
    months = months.withColumn("reimbursements_cleared", F.col("linked_cleared") + F.col("card_cleared") + F.col("business_cleared"))
    return formulae(months, entity)


def months_of(ledger: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(month): the months that the snapshot has, without its figures."""
    months = active(ledger).select(month()).distinct()
    return months if rules is None else months.union(amortization(rules, ledger).select("month")).distinct()


def formulae(months: DataFrame, entity: tuple[str, ...] = ()) -> DataFrame:
    """Burn, net and rates of each month; the rates are null without income and use the burn before it is cut off at zero."""
    c = F.col
    months = months.withColumn("gross_outflow", c("household_spend") + c("mortgage_total"))
    months = months.withColumn("cashflow_burn", c("gross_outflow") - c("refunds") - c("reimbursements_cleared"))
    normalized = c("cashflow_burn") - c("replaced") + c("addition")
    rate = lambda x: F.try_divide(x.cast("double"), c("real_income").cast("double"))
    return months.select(
        *entity,
        "month",
        *[c(m).cast(MONEY).alias(m) for m in MEASURES],
        *[c(m).cast(MONEY).alias(m) for m in ("gross_outflow", "reimbursements_cleared", "cashflow_burn")],
        F.greatest(normalized, F.lit(0)).cast(MONEY).alias("normalized_burn"),
        (c("real_income") - c("cashflow_burn")).cast(MONEY).alias("net_savings"),
        F.round(rate(c("real_income") - normalized), 6).alias("savings_rate"),
        F.round(rate(c("wealth_allocation")), 6).alias("investment_rate"),
        F.lit(0).cast(MONEY).alias("mortgage_principal_estimate"),
    )


def broken_identities(months: DataFrame) -> DataFrame:
    """Months whose net isn't income less outflow; none, as sums are exact."""
    return months.where(F.abs(F.col("net_savings") - (F.col("real_income") - F.col("cashflow_burn"))) >= 0.01)


def yearly(months: DataFrame) -> DataFrame:
    sums = ("real_income", "gross_outflow", "cashflow_burn", "normalized_burn", "net_savings", "wealth_allocation", "refunds", "reimbursements_cleared")
    years = months.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.count("*").alias("n_months"), *[F.sum(m).cast(MONEY).alias(m) for m in sums])
    return years.withColumn("savings_rate", F.round(F.try_divide((F.col("real_income") - F.col("normalized_burn")).cast("double"), F.col("real_income").cast("double")), 6))


def fire_summary(months: DataFrame, multiple: float = 25.0, as_of: str | None = None) -> DataFrame:
    """One row: average burn, annual burn, target, rates and runway. as_of (yyyy-MM): that month, if it is the last of several, is left out of averages."""
    if as_of is not None:
        of = months.agg(F.max("month").alias("last"), F.count("*").alias("n"))
        months = months.crossJoin(F.broadcast(of)).where(~((F.col("month") == as_of) & (F.col("last") == as_of) & (F.col("n") > 1))).drop("last", "n")
    x = {m: F.sum(m).cast("double") for m in ("real_income", "normalized_burn", "net_savings", "wealth_allocation")}
    burn = F.avg(F.col("normalized_burn").cast("double"))
    return months.agg(
        F.count("*").alias("n_months"),
        F.round(burn, 4).alias("monthly_burn"),
        F.round(burn * 12, 4).alias("annual_burn"),
        F.round(burn * 12 * multiple, 4).alias("fi_number"),
        F.round(F.try_divide(x["real_income"] - x["normalized_burn"], x["real_income"]), 6).alias("savings_rate"),
        F.round(F.try_divide(x["wealth_allocation"], x["real_income"]), 6).alias("investment_rate"),
        F.round(F.try_divide(x["wealth_allocation"], burn), 6).alias("runway_months"),
    )
