"""Queries over `ledger_orders`: monthly figures, periods, spending, trends, audits; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, periods, snapshots
from ..sources.tables import LEDGER_ORDERS_SQL, ledger_orders

#: Parameters of the registered queries: the order tables' own categories and subcategories stand for those of a household.
FIXED, QUASI = ("BUILDING",), ("MACHINERY",)
BUSINESS, BUSINESS_BACK = ("AUTOMOBILE", "FURNITURE"), ("1-URGENT",)
CONTROL = {"AUTOMOBILE": 0.8, "BUILDING": 0.2, "FURNITURE": 0.6}
LABELS = {"AUTOMOBILE": "Transport", "BUILDING": "Home", "FURNITURE": "Home"}
AUDIT_MONTH, EVENT_CATEGORY = "1996-03", "FURNITURE"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BURN = "economic_class IN ('household_spend', 'debt_service') AND amount < 0"


def plain(frame: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, as the SQL gives them."""
    cast = {c: F.col(c).cast("double") for c, t in frame.dtypes if t.startswith("decimal")} | {c: F.col(c).cast("string") for c, t in frame.dtypes if t == "date"}
    cast |= {c: F.col(c).cast("long") for c, t in frame.dtypes if t == "int"}
    return frame.withColumns(cast) if cast else frame


def query(name: str, sql: str | None = None):
    def add(make: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plain(make(ledger_orders(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {LEDGER_ORDERS_SQL.strip()}{sql}"
        return make

    return add


def links_of(ledger: DataFrame) -> DataFrame:
    """Links for the queries: every order of status P is an outflow that the same customer's first inflow of the month pays back in part."""
    rows = ledger.select("id", "account_id", "amount", snapshots.month())
    first = rows.where("amount > 0").groupBy("account_id", "month").agg(F.min("id").alias("inflow_id"))
    out = rows.where("amount < 0").join(first, ["account_id", "month"])
    return out.select(F.col("id").alias("outflow_id"), "inflow_id", (F.expr("cast(abs(amount) * 100 as bigint) div 2").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"))


_LINKS = """,
firsts AS (SELECT account_id, month, min(id) AS inflow_id FROM ledger WHERE amount > 0 GROUP BY account_id, month),
links AS (SELECT l.id AS outflow_id, f.inflow_id, CAST(CAST(CAST(-l.amount * 100 AS BIGINT) // 2 AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS amount, l.amount AS whole, l.month FROM ledger l JOIN firsts f USING (account_id, month) WHERE l.amount < 0)"""


def rules_of(ledger: DataFrame) -> DataFrame:
    """Amortisation rules for the queries: the active debt service of an order is spread over a year."""
    rows = snapshots.active(ledger).where("economic_class = 'debt_service'")
    return rows.select(F.col("id").alias("transaction_id"), F.round(F.abs("amount") / 12, 2).cast("decimal(18,2)").alias("monthly_amount"), F.date_format("txn_date", "yyyy-MM").alias("start_month"), F.lit(None).cast("string").alias("end_month"))


_VARIABLE = "subcategory IN ('Cash Bonus', 'RSU')"
_MONTHS = """,
months AS (
  SELECT month, sum(amount) AS net_cash_change,
    sum(CASE WHEN economic_class = 'income' THEN greatest(amount, 0) ELSE 0 END) AS real_income,
    sum(CASE WHEN economic_class = 'household_spend' THEN -least(amount, 0) ELSE 0 END) AS household_spend,
    sum(CASE WHEN economic_class = 'debt_service' THEN -least(amount, 0) ELSE 0 END) AS mortgage_total,
    sum(CASE WHEN economic_class = 'wealth_allocation' THEN -least(amount, 0) ELSE 0 END) AS wealth_allocation,
    sum(CASE WHEN economic_class = 'internal_transfer' THEN abs(amount) ELSE 0 END) AS internal_transfers,
    sum(CASE WHEN economic_class = 'reimbursement_pass_through' THEN greatest(amount, 0) ELSE 0 END) AS reimbursements_received,
    sum(CASE WHEN economic_class = 'refund' THEN greatest(amount, 0) ELSE 0 END) AS refunds
  FROM active GROUP BY month),
snap AS (
  SELECT *, household_spend + mortgage_total AS gross_outflow, household_spend + mortgage_total - refunds AS cashflow_burn FROM months)"""
_SNAPSHOT = """
SELECT month, CAST(net_cash_change AS DOUBLE) AS net_cash_change, CAST(real_income AS DOUBLE) AS real_income, CAST(real_income AS DOUBLE) AS regular_income, 0.0::DOUBLE AS variable_income,
  CAST(household_spend AS DOUBLE) AS household_spend, CAST(mortgage_total AS DOUBLE) AS mortgage_total, CAST(wealth_allocation AS DOUBLE) AS wealth_allocation,
  CAST(internal_transfers AS DOUBLE) AS internal_transfers, CAST(reimbursements_received AS DOUBLE) AS reimbursements_received, CAST(refunds AS DOUBLE) AS refunds, 0.0::DOUBLE AS unknown_card_spend,
  CAST(gross_outflow AS DOUBLE) AS gross_outflow, 0.0::DOUBLE AS reimbursements_cleared, CAST(cashflow_burn AS DOUBLE) AS cashflow_burn, CAST(greatest(cashflow_burn, 0) AS DOUBLE) AS normalized_burn,
  CAST(real_income - cashflow_burn AS DOUBLE) AS net_savings, round(CAST(real_income - cashflow_burn AS DOUBLE) / nullif(CAST(real_income AS DOUBLE), 0), 6) AS savings_rate,
  round(CAST(wealth_allocation AS DOUBLE) / nullif(CAST(real_income AS DOUBLE), 0), 6) AS investment_rate, 0.0::DOUBLE AS mortgage_principal_estimate
FROM snap"""

query("monthly_snapshot", _MONTHS + _SNAPSHOT)(snapshots.snapshots)
query("monthly_snapshot_last13", _MONTHS + _SNAPSHOT + " WHERE month IN (SELECT month FROM months ORDER BY month DESC LIMIT 13)")(lambda l: periods.filter_period(snapshots.snapshots(l), "last13"))
query("snapshot_last2years", _MONTHS + _SNAPSHOT + " WHERE left(month, 4) IN (SELECT DISTINCT left(month, 4) FROM months ORDER BY 1 DESC LIMIT 2)")(lambda l: periods.filter_period(snapshots.snapshots(l), "last2years"))
query("snapshot_years", _MONTHS + _SNAPSHOT + " WHERE left(month, 4) IN ('1996', '1998')")(lambda l: periods.filter_period(snapshots.snapshots(l), "years:1996,1998"))
query("snapshot_ytd", _MONTHS + _SNAPSHOT + " WHERE left(month, 4) = (SELECT max(left(month, 4)) FROM months)")(lambda l: periods.filter_period(snapshots.snapshots(l), "ytd"))
query("period_bounds", _MONTHS + " SELECT coalesce(min(month), '0000-00') AS first, coalesce(max(month), '9999-99') AS last FROM months WHERE left(month, 4) IN ('1996', '1998')")(lambda l: periods.bounds(periods.filter_period(snapshots.aggregate_months(l), "years:1996,1998")))
query("snapshot_identity", _MONTHS + " SELECT month FROM months WHERE false")(lambda l: snapshots.broken_identities(snapshots.snapshots(l)).select("month"))
query(
    "yearly_rollup",
    _MONTHS
    + """ SELECT left(month, 4) AS year, count(*) AS n_months, CAST(sum(real_income) AS DOUBLE) AS real_income, CAST(sum(gross_outflow) AS DOUBLE) AS gross_outflow, CAST(sum(cashflow_burn) AS DOUBLE) AS cashflow_burn,
  CAST(sum(greatest(cashflow_burn, 0)) AS DOUBLE) AS normalized_burn, CAST(sum(real_income - cashflow_burn) AS DOUBLE) AS net_savings, CAST(sum(wealth_allocation) AS DOUBLE) AS wealth_allocation, CAST(sum(refunds) AS DOUBLE) AS refunds, 0.0::DOUBLE AS reimbursements_cleared,
  round(CAST(sum(real_income) - sum(greatest(cashflow_burn, 0)) AS DOUBLE) / nullif(CAST(sum(real_income) AS DOUBLE), 0), 6) AS savings_rate FROM snap GROUP BY 1""",
)(lambda l: snapshots.yearly(snapshots.snapshots(l)))
query(
    "fire_summary",
    _MONTHS
    + """ SELECT count(*) AS n_months, round(avg(CAST(greatest(cashflow_burn, 0) AS DOUBLE)), 4) AS monthly_burn, round(avg(CAST(greatest(cashflow_burn, 0) AS DOUBLE)) * 12, 4) AS annual_burn, round(avg(CAST(greatest(cashflow_burn, 0) AS DOUBLE)) * 12 * 25.0::DOUBLE, 4) AS fi_number,
  round((sum(CAST(real_income AS DOUBLE)) - sum(CAST(greatest(cashflow_burn, 0) AS DOUBLE))) / sum(CAST(real_income AS DOUBLE)), 6) AS savings_rate, round(sum(CAST(wealth_allocation AS DOUBLE)) / sum(CAST(real_income AS DOUBLE)), 6) AS investment_rate,
  round(sum(CAST(wealth_allocation AS DOUBLE)) / avg(CAST(greatest(cashflow_burn, 0) AS DOUBLE)), 6) AS runway_months FROM snap""",
)(lambda l: snapshots.fire_summary(snapshots.snapshots(l)))

_BREAKDOWN = """ SELECT economic_class, category, subcategory, CAST(sum(-least(amount, 0)) AS DOUBLE) AS outflow, CAST(sum(greatest(amount, 0)) AS DOUBLE) AS inflow, count(*) AS n, round(avg(confidence), 6) AS avg_confidence
FROM active GROUP BY economic_class, category, subcategory"""
query("spending_breakdown", _BREAKDOWN)(analytics.spending_breakdown)
query("category_month", f" SELECT month, category, CAST(sum(-amount) AS DOUBLE) AS outflow FROM active WHERE {BURN} GROUP BY month, category")(analytics.category_month)
query("merchant_category_month", f" SELECT merchant, category, month, CAST(sum(-amount) AS DOUBLE) AS outflow, count(*) AS n FROM active WHERE {BURN} GROUP BY merchant, category, month")(analytics.merchant_category_month)
query("category_year", f" SELECT CAST(year(txn_date) AS BIGINT) AS year, category, CAST(sum(-amount) AS DOUBLE) AS outflow FROM active WHERE {BURN} GROUP BY 1, 2")(analytics.category_year)
query("spend_months", f" SELECT CAST(year(txn_date) AS BIGINT) AS year, count(DISTINCT month) AS n_months FROM active WHERE {BURN} GROUP BY 1")(analytics.spend_months)
query(
    "year_totals",
    """ SELECT CAST(year(txn_date) AS BIGINT) AS year, CAST(sum(CASE WHEN economic_class IN ('household_spend', 'debt_service') THEN -least(amount, 0) ELSE 0 END) AS DOUBLE) AS spend,
  CAST(sum(CASE WHEN economic_class = 'income' THEN greatest(amount, 0) ELSE 0 END) AS DOUBLE) AS income FROM active GROUP BY 1""",
)(analytics.year_totals)
_KIND = f""",
kinds AS (SELECT month, -amount AS x, CASE WHEN category = 'BUILDING' OR economic_class = 'debt_service' OR regexp_matches(upper(merchant), '0007$') THEN 'fixed' WHEN category = 'MACHINERY' THEN 'quasi' ELSE 'variable' END AS kind FROM active WHERE {BURN}),
split AS (SELECT month, CAST(sum(CASE WHEN kind = 'fixed' THEN x ELSE 0 END) AS DOUBLE) AS fixed, CAST(sum(CASE WHEN kind = 'quasi' THEN x ELSE 0 END) AS DOUBLE) AS quasi, CAST(sum(CASE WHEN kind = 'variable' THEN x ELSE 0 END) AS DOUBLE) AS variable FROM kinds GROUP BY month)"""
_split = lambda l: analytics.fixed_variable_split(l, FIXED, QUASI, "0007$")
query("fixed_variable_split", _KIND + " SELECT * FROM split")(_split)
query("fixed_variable_averages", _KIND + " SELECT count(*) AS n_months, round(avg(fixed), 4) AS avg_fixed, round(avg(quasi), 4) AS avg_quasi, round(avg(variable), 4) AS avg_variable FROM split")(lambda l: analytics.fixed_variable_averages(_split(l)))
query(
    "data_health",
    """, h AS (SELECT *, abs(amount) AS x, CASE WHEN confidence < 0.65 THEN 'low' WHEN confidence < 0.85 THEN 'medium' ELSE 'high' END AS band FROM ledger)
SELECT count(*) FILTER (WHERE NOT is_duplicate) AS transactions, count(*) FILTER (WHERE is_duplicate) AS duplicates, count(economic_class) AS annotated,
  CAST(coalesce(sum(x) FILTER (WHERE NOT is_duplicate AND economic_class = 'needs_review'), 0) AS DOUBLE) AS needs_review_value,
  CAST(coalesce(sum(x) FILTER (WHERE NOT is_duplicate AND economic_class = 'reimbursement_pass_through' AND amount > 0), 0) AS DOUBLE) AS reimbursements_received,
  CAST(coalesce(sum(x) FILTER (WHERE NOT is_duplicate AND band = 'low'), 0) AS DOUBLE) AS value_low, CAST(coalesce(sum(x) FILTER (WHERE NOT is_duplicate AND band = 'medium'), 0) AS DOUBLE) AS value_medium,
  CAST(coalesce(sum(x) FILTER (WHERE NOT is_duplicate AND band = 'high'), 0) AS DOUBLE) AS value_high FROM h""",
)(analytics.data_health)
query(
    "linked_reimbursements",
    _LINKS + " SELECT month, CAST(sum(least(amount, -whole)) AS DOUBLE) AS cleared FROM links GROUP BY month",
)(lambda l: snapshots.linked_reimbursements(l, links_of(l))[0])
query(
    "bucket_totals",
    _LINKS
    + f""", sums AS (SELECT outflow_id, sum(amount) AS linked FROM links GROUP BY outflow_id)
SELECT month, category, subcategory, CAST(sum(-a.amount) AS DOUBLE) AS gross, CAST(sum(greatest(0, -a.amount - coalesce(linked, 0))) AS DOUBLE) AS net, count(*) AS n
FROM active a LEFT JOIN sums ON outflow_id = id WHERE {BURN.replace('amount', 'a.amount')} GROUP BY month, category, subcategory""",
)(lambda l: analytics.bucket_totals(l, links_of(l)))
query(
    "bucket_top_merchants",
    f""", s AS (SELECT category, merchant, sum(-amount) AS spend FROM active WHERE {BURN} GROUP BY category, merchant), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY spend DESC, merchant) AS rank FROM s)
SELECT category, merchant, CAST(spend AS DOUBLE) AS spend, rank FROM r WHERE rank <= 5""",
)(analytics.bucket_top_merchants)
_FIFO = """,
q AS (SELECT month, {spend} AS spend, {received} AS received FROM {source}),
r AS (SELECT *, sum(spend) OVER w AS s, sum(received) OVER w AS r FROM q WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, r + least(0, min(s - r) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)) AS c FROM r)
SELECT month, CAST(spend AS DOUBLE) AS spend, CAST(received AS DOUBLE) AS received, CAST(c - coalesce(lag(c) OVER (ORDER BY month), 0) AS DOUBLE) AS payback_used,
  CAST(greatest(0, least(spend, max(c) OVER () - (s - spend))) AS DOUBLE) AS cleared FROM c"""
query("fifo_clearing", _MONTHS + _FIFO.format(spend="household_spend", received="reimbursements_received", source="months"))(
    lambda l: snapshots.fifo_clearing(snapshots.aggregate_months(l).select("month", F.col("household_spend").alias("spend"), F.col("reimbursements_received").alias("received")), "spend", "received")
)
query(
    "business_fifo",
    """, b AS (SELECT month, sum(CASE WHEN amount < 0 AND economic_class = 'household_spend' AND category IN ('AUTOMOBILE', 'FURNITURE') THEN -amount ELSE 0 END) AS bs,
  sum(CASE WHEN amount > 0 AND economic_class = 'reimbursement_pass_through' AND subcategory = '1-URGENT' THEN amount ELSE 0 END) AS br FROM active
  WHERE (amount < 0 AND economic_class = 'household_spend' AND category IN ('AUTOMOBILE', 'FURNITURE')) OR (amount > 0 AND economic_class = 'reimbursement_pass_through' AND subcategory = '1-URGENT') GROUP BY month)"""
    + _FIFO.format(spend="bs", received="br", source="b"),
)(lambda l: snapshots.fifo_clearing(snapshots.business_months(l, None, BUSINESS, BUSINESS_BACK).select("month", F.col("business_spend").alias("spend"), F.col("business_received").alias("received")), "spend", "received"))
query(
    "amortization_spread",
    """, rules AS (SELECT id, CAST(CAST((CAST(-amount * 100 AS BIGINT) * 2 + 12) // 24 AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS m, date_trunc('month', txn_date) AS d, -amount AS whole FROM active WHERE economic_class = 'debt_service'),
e AS (SELECT strftime(d + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month, m AS addition, 0 AS replaced FROM rules, range(12) t(k) UNION ALL SELECT strftime(d, '%Y-%m'), 0, whole FROM rules)
SELECT month, CAST(sum(addition) AS DOUBLE) AS addition, CAST(sum(replaced) AS DOUBLE) AS replaced FROM e GROUP BY month""",
)(lambda l: snapshots.amortization(rules_of(l), l))
QUERIES["snapshot_with_links_and_rules"] = lambda spark, sf_dir: plain((lambda l: snapshots.snapshots(l, links_of(l), rules_of(l)))(ledger_orders(spark, sf_dir)))
query(
    "recurring_merchants",
    f""", m AS (SELECT merchant, category, month, CAST(sum(-amount) AS DECIMAL(18,2)) AS spent FROM active WHERE {BURN} GROUP BY merchant, category, month),
t AS (SELECT *, CAST(sum(spent) OVER w AS DECIMAL(18,2)) AS total, CAST(count(*) OVER w AS DECIMAL(6,0)) AS n FROM m WINDOW w AS (PARTITION BY merchant, category)),
s AS (SELECT merchant, category, count(*) AS n_months, max(total) AS total, CAST(sum(abs(spent * n - total)) AS DOUBLE) / (count(*) * count(*)) AS mad, CAST(max(total) AS DOUBLE) / count(*) AS mean FROM t GROUP BY merchant, category),
f AS (SELECT *, greatest(0.0::DOUBLE, 1 - coalesce(mad / nullif(mean, 0), 0)) AS stability FROM s WHERE n_months >= 2 OR total >= 500)
SELECT merchant, category, n_months, CAST(total AS DOUBLE) AS total, mean AS monthly_mean, mad, stability, CASE WHEN n_months >= 3 AND stability >= 0.65 THEN 'monthly' ELSE 'irregular' END AS cadence, mean * 12 AS annualized FROM f""",
)(analytics.recurring_merchants)
query(
    "category_trends",
    f""", s AS (SELECT month, category, CAST(sum(-amount) AS DOUBLE) AS x FROM active WHERE {BURN} GROUP BY month, category),
r AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM s)),
p AS (SELECT category, sum(CASE WHEN k <= 3 THEN x ELSE 0 END) AS a, sum(CASE WHEN k > 3 THEN x ELSE 0 END) AS b FROM s JOIN r USING (month) WHERE k <= 6 AND n >= 4 GROUP BY category),
z AS (SELECT count(*) FILTER (WHERE k <= 3) AS na, count(*) FILTER (WHERE k BETWEEN 4 AND 6) AS nb FROM r),
o AS (SELECT category, round(a / na, 4) AS recent_avg, round(coalesce(b / nullif(nb, 0), 0), 4) AS prior_avg, round(CASE WHEN b > 0 THEN (a / na - b / nb) / (b / nb) ELSE 1.0 END, 6) AS change FROM p, z)
SELECT * FROM o WHERE recent_avg >= 75 AND abs(change) >= 0.15""",
)(analytics.category_trends)
query(
    "optimization",
    f""", s AS (SELECT category, CAST(sum(-amount) AS DOUBLE) AS outflow FROM active WHERE {BURN} GROUP BY category),
c AS (SELECT *, CASE category WHEN 'AUTOMOBILE' THEN 0.8::DOUBLE WHEN 'BUILDING' THEN 0.2::DOUBLE WHEN 'FURNITURE' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS controllability FROM s)
SELECT category, outflow, controllability, round(outflow / sum(outflow) OVER (), 6) AS share, round(outflow * controllability, 4) AS score,
  CASE WHEN controllability >= 0.75 THEN 'highly controllable' WHEN controllability >= 0.45 THEN 'partly controllable' ELSE 'hard to change' END AS reason FROM c ORDER BY score DESC, category LIMIT 8""",
)(lambda l: analytics.optimization(l, CONTROL))
_YEARS = f""",
cy AS (SELECT CAST(year(txn_date) AS BIGINT) AS year, category, sum(-amount) AS x FROM active WHERE {BURN} GROUP BY 1, 2)"""
query(
    "yoy_shifts",
    _YEARS
    + f""", m AS (SELECT CAST(year(txn_date) AS BIGINT) AS year, count(DISTINCT month) AS n FROM active WHERE {BURN} GROUP BY 1),
y AS (SELECT year AS prior_year, lead(year) OVER (ORDER BY year) AS year, n FROM m), p AS (SELECT y.prior_year, y.year FROM y JOIN m ON m.year = y.year WHERE y.n >= 12 AND m.n >= 12),
j AS (SELECT p.prior_year, p.year, c.category, CAST(c.x AS DOUBLE) AS b, CAST(coalesce(d.x, 0) AS DOUBLE) AS a FROM p JOIN cy c ON c.year = p.prior_year LEFT JOIN cy d ON d.year = p.year AND d.category = c.category),
o AS (SELECT prior_year, year, category, round(a - b, 2) AS delta, round((a - b) / b * 100, 4) AS pct FROM j WHERE b > 100),
r AS (SELECT *, printf('%+.1f%%', pct) AS shown, row_number() OVER (PARTITION BY year ORDER BY abs(delta) DESC, category) AS rank FROM o WHERE abs(pct) > 15)
SELECT * FROM r WHERE rank <= 5""",
)(analytics.yoy_shifts)
query(
    "jump_drivers",
    _YEARS
    + """, y AS (SELECT year, lag(year) OVER (ORDER BY year) AS before FROM (SELECT DISTINCT year FROM cy)),
k AS (SELECT y.year, y.before, c.category FROM y JOIN cy c ON c.year = y.year OR c.year = y.before WHERE y.before IS NOT NULL GROUP BY ALL),
d AS (SELECT k.year, k.category, coalesce(a.x, 0) - coalesce(b.x, 0) AS delta FROM k LEFT JOIN cy a ON a.year = k.year AND a.category = k.category LEFT JOIN cy b ON b.year = k.before AND b.category = k.category),
r AS (SELECT year, category, CAST(delta AS DOUBLE) AS delta, CAST(sum(delta) OVER (PARTITION BY year) AS DOUBLE) AS year_delta, row_number() OVER (PARTITION BY year ORDER BY abs(delta) DESC, category) AS rank FROM d)
SELECT * FROM r WHERE rank <= 3""",
)(analytics.jump_drivers)
query(
    "event_months",
    f""", s AS (SELECT month, category, sum(-amount) AS x FROM active WHERE {BURN} GROUP BY month, category), w AS (SELECT month FROM s WHERE category = 'FURNITURE' ORDER BY x DESC, month LIMIT 1),
r AS (SELECT 'peak' AS event, month, category, CAST(x AS DOUBLE) AS outflow, row_number() OVER (ORDER BY x DESC, category) AS rank FROM s WHERE month = (SELECT month FROM w)) SELECT * FROM r WHERE rank <= 3""",
)(lambda l: analytics.event_months(l, l.sparkSession.createDataFrame([("peak", EVENT_CATEGORY)], "event string, category string")))
query(
    "amortization_suggestions",
    f""", seen AS (SELECT merchant, count(DISTINCT month) AS n FROM active WHERE {BURN} GROUP BY merchant)
SELECT id, CAST(-amount AS DOUBLE) AS annual_amount, CAST(CAST(CAST((CAST(-amount * 100 AS BIGINT) * 2 + 12) // 24 AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2)) AS DOUBLE) AS monthly_amount, month AS start_month, strftime(txn_date + to_months(11), '%Y-%m') AS end_month
FROM active LEFT JOIN seen USING (merchant) WHERE economic_class = 'household_spend' AND amount <= -1500 AND category <> 'BUILDING' AND coalesce(n, 1) - 1 < 3""",
)(lambda l: analytics.amortization_suggestions(l, FIXED))
query(
    "category_suggestions",
    f""", s AS (SELECT category, sum(-least(amount, 0)) AS o, count(DISTINCT subcategory) AS n FROM active GROUP BY category)
SELECT category, CAST(o AS DOUBLE) AS outflow, n AS n_subcategories FROM s WHERE o >= 2000 OR n >= 2 ORDER BY o DESC, category LIMIT 6""",
)(lambda l: analytics.category_suggestions(analytics.spending_breakdown(l)))
query(
    "bucket_labels",
    f""", b AS ({_BREAKDOWN.strip()}) SELECT CASE category WHEN 'AUTOMOBILE' THEN 'Transport' WHEN 'BUILDING' THEN 'Home' WHEN 'FURNITURE' THEN 'Home' ELSE category END AS label,
  round(sum(outflow), 2) AS outflow, CAST(sum(n) AS BIGINT) AS n, round(avg(avg_confidence), 6) AS avg_confidence, array_to_string(list_sort(list(DISTINCT subcategory)), ',') AS subcategories FROM b GROUP BY 1""",
)(lambda l: analytics.rebucket(analytics.spending_breakdown(l), LABELS))
query(
    "nearest_rank_percentile",
    f" SELECT category, CAST(percentile_disc(0.9) WITHIN GROUP (ORDER BY x) AS DOUBLE) AS percentile FROM (SELECT category, sum(-amount) AS x FROM active WHERE {BURN} GROUP BY month, category) GROUP BY category",
)(lambda l: analytics.nearest_rank(analytics.category_month(l), ["category"], "outflow", 0.9))
query(
    "month_audit",
    _LINKS
    + f""", sums AS (SELECT outflow_id, sum(amount) AS linked FROM links GROUP BY outflow_id),
r AS (SELECT id, CAST(txn_date AS VARCHAR) AS txn_date, merchant, category, CAST(confidence AS DOUBLE) AS confidence, a.amount AS amount, coalesce(linked, 0) AS linked, greatest(0, -a.amount - coalesce(linked, 0)) AS net FROM active a LEFT JOIN sums ON outflow_id = id WHERE month = '{AUDIT_MONTH}' AND {BURN.replace('amount', 'a.amount')})
SELECT id, txn_date, merchant, category, confidence, CAST(amount AS DOUBLE) AS amount, CAST(linked AS DOUBLE) AS linked, CAST(net AS DOUBLE) AS net_outflow, CASE WHEN net = 0 OR confidence >= 0.995 THEN 'done' WHEN linked > 0 THEN 'linked' ELSE 'open' END AS link_state FROM r""",
)(lambda l: analytics.month_audit(l, AUDIT_MONTH, links_of(l)))
query("month_income", f" SELECT id, CAST(txn_date AS VARCHAR) AS txn_date, merchant, category, CAST(amount AS DOUBLE) AS amount FROM active WHERE economic_class = 'income' AND amount > 0 AND month = '{AUDIT_MONTH}'")(lambda l: analytics.month_income(l, AUDIT_MONTH))
query(
    "transactions_search",
    """ SELECT id, account_id, CAST(txn_date AS VARCHAR) AS txn_date, CAST(amount AS DOUBLE) AS amount, merchant, category, subcategory, economic_class, CAST(confidence AS DOUBLE) AS confidence, is_duplicate
FROM ledger WHERE category IN ('BUILDING', 'MACHINERY') AND confidence >= 0.65 AND confidence < 0.85 AND merchant ILIKE '%customer%1%'""",
)(lambda l: analytics.search(l, categories=("BUILDING", "MACHINERY"), band="medium", text="customer%1", limit=None))
query("class_counts", " SELECT economic_class, count(*) AS n FROM active GROUP BY economic_class")(lambda l: snapshots.active(l).groupBy("economic_class").agg(F.count("*").alias("n")))
