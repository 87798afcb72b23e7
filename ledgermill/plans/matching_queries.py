"""Queries that pair rows, over events and orders. The SQL of one-to-one choices goes through the edges one by one, by recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, matching
from ..sources.tables import LEDGER_EVENTS_SQL, LEDGER_ORDERS_SQL, ledger_events, ledger_orders
from .ledger_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, ledger: Callable, sql: str | None = None):
    def add(make: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plain(make(ledger(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {(LEDGER_EVENTS_SQL if ledger is ledger_events else LEDGER_ORDERS_SQL).strip()}{sql}"
        return make

    return add


def one_by_one(edges: str, order: str, a: str, b: str, columns: str) -> str:
    """SQL that takes edges in order, each if neither of its ends was taken."""
    used = f"(list_contains(used, {a}) OR list_contains(used, {b}))"
    return f""", c AS ({edges}), k AS (SELECT *, row_number() OVER (ORDER BY {order}, {a}, {b}) AS n FROM c),
g(n, used, taken) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT k.n, CASE WHEN {used} THEN used ELSE list_concat(used, [{a}, {b}]) END, NOT {used} FROM g JOIN k ON k.n = g.n + 1)
SELECT {columns} FROM k JOIN g USING (n) WHERE taken"""


_E = """,
e AS (SELECT *, CAST(abs(amount) * 100 AS BIGINT) AS cents FROM ledger)"""
_TRANSFERS = """SELECT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, abs(date_diff('day', a.txn_date, b.txn_date)) AS days, CAST(a.amount AS DOUBLE) AS amount
FROM e a JOIN e b ON a.cents = b.cents AND a.amount > 0 AND b.amount < 0 AND a.account_id <> b.account_id AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 3"""
query("transfer_candidates", ledger_events, f"{_E} {_TRANSFERS}")(matching.transfer_candidates)
query("transfer_pairs", ledger_events, _E + one_by_one(_TRANSFERS, "days, amount DESC", "left_id", "right_id", "left_id, right_id, days, amount"))(matching.transfer_pairs)
_bank = lambda l: l.where("category = 'purchase'")
_card = lambda l: l.where("category = 'signup'")
_SETTLED = """SELECT a.id AS bank_id, b.id AS card_id, abs(date_diff('day', a.txn_date, b.txn_date)) AS gap, CAST(a.txn_date AS VARCHAR) AS bank_date, CAST(b.txn_date AS VARCHAR) AS card_date
FROM e a JOIN e b ON a.category = 'purchase' AND b.category = 'signup' AND a.amount < 0 AND b.amount > 0 AND abs(a.cents - b.cents) <= 1 AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 7"""
query("settlement_candidates", ledger_events, f"{_E} {_SETTLED}")(lambda l: matching.settlement_candidates(_bank(l), _card(l)))
query("settlement_pairs", ledger_events, _E + one_by_one(_SETTLED, "bank_date, bank_id, gap, card_date", "bank_id", "card_id", "bank_id, card_id, gap"))(lambda l: matching.settlement_pairs(_bank(l), _card(l)))
_refund = """ AND o.txn_date <= i.txn_date AND date_diff('day', o.txn_date, i.txn_date) <= {days} AND abs(-o.amount - i.amount) <= greatest({least}, i.amount * {share})"""
query(
    "refund_pairs",
    ledger_orders,
    """, m AS (SELECT i.id AS inflow_id, o.id AS outflow_id, o.txn_date, i.amount, row_number() OVER (PARTITION BY i.id ORDER BY o.txn_date, o.id) AS k FROM ledger i JOIN ledger o ON o.account_id = i.account_id AND i.amount > 0 AND o.amount < 0"""
    + _refund.format(days=120, least=10, share=0.2)
    + ") SELECT inflow_id, outflow_id, CAST(txn_date AS VARCHAR) AS outflow_date, CAST(amount AS DOUBLE) AS amount FROM m WHERE k = 1",
)(lambda l: matching.refund_pairs(l, l, ["account_id"]))
_REPAID = """SELECT i.id AS inflow_id, o.id AS outflow_id, CAST(i.txn_date AS VARCHAR) AS in_date, CAST(abs(-o.amount - i.amount) AS DOUBLE) AS difference, -date_diff('day', DATE '1970-01-01', o.txn_date) AS late, CAST(least(i.amount, -o.amount) AS DOUBLE) AS amount
FROM ledger i JOIN ledger o ON o.account_id = i.account_id AND i.amount > 0 AND o.amount < 0{}""" + _refund.format(days=200, least=1, share=0.1)
query("reimbursement_candidates", ledger_orders, " " + _REPAID.replace("{}", ""))(lambda l: matching.reimbursement_candidates(l, l, ["account_id"], days=200, share=0.1))
query(
    "reimbursement_links",
    ledger_orders,
    one_by_one(_REPAID.replace("{}", " AND i.amount >= 500"), "in_date, inflow_id, difference, late", "inflow_id", "outflow_id", "inflow_id, outflow_id, amount, CASE WHEN difference < 0.01 THEN 0.98::DOUBLE ELSE 0.92::DOUBLE END AS confidence"),
)(lambda l: matching.reimbursement_links(l, l, ["account_id"], days=200, share=0.1))
query(
    "nearest_offset",
    ledger_orders,
    """, m AS (SELECT i.id AS inflow_id, o.id AS outflow_id, abs(date_diff('day', i.txn_date, o.txn_date)) AS gap FROM ledger i JOIN ledger o ON o.account_id = i.account_id AND i.amount > 0 AND o.amount < 0 AND abs(date_diff('day', i.txn_date, o.txn_date)) <= 365 AND -o.amount >= 3 * i.amount),
r AS (SELECT *, row_number() OVER (PARTITION BY inflow_id ORDER BY gap, outflow_id) AS k FROM m) SELECT inflow_id, outflow_id, gap FROM r WHERE k = 1""",
)(lambda l: matching.nearest_offset(l, l, ["account_id"]))
query(
    "best_later_inflow",
    ledger_orders,
    """, m AS (SELECT o.id AS outflow_id, i.id AS inflow_id, abs(-o.amount - i.amount) AS d, i.txn_date FROM ledger o JOIN ledger i ON o.account_id = i.account_id AND i.amount > 0 AND o.amount < 0 AND date_diff('day', o.txn_date, i.txn_date) BETWEEN 0 AND 200 AND abs(-o.amount - i.amount) <= greatest(1, -o.amount * 0.1)),
r AS (SELECT *, row_number() OVER (PARTITION BY outflow_id ORDER BY d, txn_date, inflow_id) AS k FROM m) SELECT outflow_id, inflow_id, CAST(d AS DOUBLE) AS difference FROM r WHERE k = 1""",
)(lambda l: matching.best_later_inflow(l, l, ["account_id"], days=200, share=0.1))


def _asof(l: DataFrame) -> DataFrame:
    views = l.where("category = 'view'").groupBy("account_id", F.col("ts").alias("rate_ts")).agg(F.max("amount").alias("rate"))
    return matching.asof(l.where("category = 'purchase'").select("id", "account_id", "ts", "amount"), views, "account_id", "ts", "rate_ts", "rate", "view_amount").select("id", "view_amount")


query(
    "asof_rate",
    ledger_events,
    """, v AS (SELECT account_id, ts, max(amount) AS rate FROM ledger WHERE category = 'view' GROUP BY account_id, ts), p AS (SELECT * FROM ledger WHERE category = 'purchase')
SELECT p.id, CAST(v.rate AS DOUBLE) AS view_amount FROM p ASOF LEFT JOIN v ON p.account_id = v.account_id AND p.ts >= v.ts""",
)(_asof)
query(
    "recurring_debits",
    ledger_events,
    """, r AS (SELECT account_id, category, txn_date, id, -amount AS size, CAST(round_even(CAST(-amount AS DOUBLE) / 100.0::DOUBLE, 0) * 100 AS BIGINT) AS bucket FROM ledger WHERE amount < 0),
m AS (SELECT *, date_diff('day', lag(txn_date) OVER w, txn_date) AS days, CAST(sum(size) OVER v AS DECIMAL(18,2)) AS total, CAST(count(*) OVER v AS DECIMAL(9,0)) AS many FROM r
  WINDOW w AS (PARTITION BY account_id, category, bucket ORDER BY txn_date, id), v AS (PARTITION BY account_id, category, bucket)),
g AS (SELECT account_id, category, bucket, count(*) AS n, CAST(max(total) AS DOUBLE) / count(*) AS mean, CAST(sum(abs(size * many - total)) AS DOUBLE) / (count(*) * count(*)) AS mad, count(*) FILTER (WHERE days BETWEEN 1 AND 10) AS n_regular FROM m GROUP BY account_id, category, bucket)
SELECT * FROM g WHERE n >= 4 AND mad <= mean * 0.5::DOUBLE AND n_regular >= greatest(1, n - 2)""",
)(lambda l: detect.recurring_debits(l, ["account_id", "category"], bucket=100.0, occurrences=4, deviation_limit=0.5, gap=(1, 10), least_gaps=1))
_ISLANDS = """, r AS (SELECT *, CASE WHEN date_diff('day', lag(txn_date) OVER w, txn_date) > 2 THEN 1 WHEN lag(txn_date) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ledger WHERE amount < 0 WINDOW w AS (PARTITION BY account_id ORDER BY txn_date, id)),
n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY account_id ORDER BY txn_date, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip FROM r)
SELECT account_id, trip, CAST(min(txn_date) AS VARCHAR) AS first_day, CAST(max(txn_date) AS VARCHAR) AS last_day, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM n GROUP BY account_id, trip HAVING count(*) >= 3"""
query("trip_islands", ledger_events, _ISLANDS)(lambda l: detect.trip_islands(l, ["account_id"], gap=2))
query(
    "salary_upper_median",
    ledger_orders,
    """ SELECT account_id, count(DISTINCT month) AS n_months, count(*) AS n, CAST(list_sort(list(amount))[len(list(amount)) // 2 + 1] AS DOUBLE) AS median FROM ledger WHERE amount > 0 GROUP BY account_id HAVING count(DISTINCT month) >= 2""",
)(lambda l: detect.salary_groups(l, ["account_id"]))
query(
    "salaries",
    ledger_orders,
    """, g AS (SELECT account_id, count(DISTINCT month) AS m, list_sort(list(amount))[len(list(amount)) // 2 + 1] AS median FROM ledger WHERE amount >= 1500 GROUP BY account_id)
SELECT id, CAST(median AS DOUBLE) AS median FROM ledger JOIN g USING (account_id) WHERE m >= 2 AND amount >= 1500 AND abs(amount - median) <= greatest(250, median * 0.12)""",
)(lambda l: detect.salaries(l, ["account_id"]).select("id", "median"))
query(
    "pay_window",
    ledger_orders,
    """ SELECT id, CASE WHEN month(txn_date) = 12 THEN day(txn_date) BETWEEN 18 AND 26 WHEN isodow(make_date(year(txn_date), month(txn_date), 25)) = 6 THEN day(txn_date) BETWEEN 24 AND 25
  WHEN isodow(make_date(year(txn_date), month(txn_date), 25)) = 7 THEN day(txn_date) BETWEEN 25 AND 26 ELSE day(txn_date) BETWEEN 24 AND 26 END AS in_window FROM ledger""",
)(lambda l: l.select("id", detect.pay_window(F.col("txn_date")).alias("in_window")))
query(
    "expected_calendar",
    ledger_orders,
    """, m AS (SELECT subcategory, date_trunc('month', txn_date) AS d, sum(amount) AS observed FROM ledger WHERE amount > 0 AND economic_class = 'income' GROUP BY 1, 2),
x AS (SELECT max(txn_date) AS latest FROM ledger WHERE economic_class = 'income'), b AS (SELECT CASE WHEN day(latest) >= 28 THEN date_trunc('month', latest) ELSE date_trunc('month', latest) - to_months(1) END AS last FROM x),
g AS (SELECT subcategory, min(d) AS first, list_sort(list(observed))[len(list(observed)) // 2 + 1] AS expected FROM m GROUP BY subcategory HAVING count(*) >= 2),
s AS (SELECT subcategory, expected, CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS d FROM g, b),
j AS (SELECT s.*, CAST(coalesce(observed, 0) AS DECIMAL(18,2)) AS observed, greatest(CAST(750 AS DECIMAL(18,2)), CAST(CAST(expected AS DECIMAL(18,2)) * CAST(0.18 AS DECIMAL(6,4)) AS DECIMAL(18,2))) AS tolerance FROM s LEFT JOIN m ON m.subcategory = s.subcategory AND CAST(m.d AS DATE) = s.d)
SELECT subcategory, strftime(d, '%Y-%m') AS month, CAST(expected AS DOUBLE) AS expected, CAST(observed AS DOUBLE) AS observed, CAST(tolerance AS DOUBLE) AS tolerance, observed + tolerance >= expected AS satisfied FROM j""",
)(lambda l: detect.expected_calendar(l.where("economic_class = 'income'"), ["subcategory"]))


def rules(spark: SparkSession) -> DataFrame:
    rows = [
        (1, 50, None, None, "customer#000000001", "out", None, None, None, None, "household_spend", "Groceries", 0.96),
        (2, 40, None, 3, None, None, None, None, 1000.0, [1, 2, 3], "income", "Salary", 0.96),
        (3, 10, 7, None, None, None, None, None, None, None, "refund", "Refund", 0.99),
        (4, 1, None, None, "er#", "in", None, None, None, None, "income", "Bonus", 0.5),  # too short to be safe
        (5, 60, None, None, None, "out", None, None, None, None, "needs_review", "Uncategorized", 0.5),  # no scope
        (6, 60, None, None, "#0000000", "in", 5000.0, 4000.0, None, None, "income", "Other", 0.7),  # no letter
    ]
    return spark.createDataFrame(rows, detect.RULE_SCHEMA)


_RULES = """, z AS (SELECT id, CASE WHEN id = 7 THEN 3 WHEN account_id = 3 AND abs(amount) >= 1000 AND month(txn_date) IN (1, 2, 3) THEN 2 WHEN upper(merchant) LIKE '%CUSTOMER#000000001%' AND amount < 0 THEN 1 END AS r, abs(amount) AS x FROM ledger)"""
query(
    "rule_match",
    ledger_orders,
    _RULES
    + """ SELECT id, CAST(r AS BIGINT) AS rule_id, CASE r WHEN 1 THEN 'household_spend' WHEN 2 THEN 'income' ELSE 'refund' END AS economic_class, CASE r WHEN 1 THEN 'Groceries' WHEN 2 THEN 'Salary' ELSE 'Refund' END AS category,
  CASE r WHEN 3 THEN 0.99::DOUBLE ELSE 0.96::DOUBLE END AS confidence FROM z WHERE r IS NOT NULL""",
)(lambda l: detect.match_rules(l, rules(l.sparkSession)))
query(
    "rule_audit",
    ledger_orders,
    _RULES + " SELECT CAST(k AS BIGINT) AS rule_id, count(r) AS n, CAST(coalesce(sum(x), 0) AS DOUBLE) AS value FROM range(1, 7) t(k) LEFT JOIN z ON r = k GROUP BY k",
)(lambda l: detect.rule_audit(l, rules(l.sparkSession)))
query(
    "digest_tier",
    ledger_orders,
    """ SELECT id, CASE WHEN economic_class = 'needs_review' THEN 'review' WHEN confidence < 0.7 THEN CASE WHEN category = 'Uncategorized' THEN 'review' ELSE 'auto_visible' END WHEN confidence >= 0.9 THEN 'auto_silent' ELSE 'auto_visible' END AS tier FROM ledger""",
)(lambda l: l.select("id", detect.digest_tier(F.col("economic_class"), F.col("category"), F.col("confidence")).alias("tier")))
query(
    "classify",
    ledger_orders,
    """, c AS (SELECT id, CASE WHEN is_duplicate THEN 'duplicate' WHEN subcategory = '1-URGENT' AND amount > 0 THEN 'salary' WHEN category = 'BUILDING' AND amount < 0 THEN 'mortgage' WHEN merchant LIKE '%7' THEN 'merchant'
  WHEN amount > 0 AND abs(amount) < 500 THEN 'small credit' WHEN amount > 0 THEN 'large credit' WHEN abs(amount) >= 250 THEN 'material unknown' ELSE 'other' END AS rule FROM ledger),
v AS (SELECT id, rule, CASE rule WHEN 'duplicate' THEN 'ignore_noise' WHEN 'salary' THEN 'income' WHEN 'mortgage' THEN 'debt_service' WHEN 'merchant' THEN 'household_spend' WHEN 'small credit' THEN 'refund' WHEN 'other' THEN 'household_spend' ELSE 'needs_review' END AS economic_class,
  CASE rule WHEN 'duplicate' THEN 'Duplicate' WHEN 'salary' THEN 'Salary' WHEN 'mortgage' THEN 'Mortgage' WHEN 'merchant' THEN 'Groceries' WHEN 'small credit' THEN 'Other' WHEN 'other' THEN 'Other' ELSE 'Uncategorized' END AS category,
  CASE rule WHEN 'duplicate' THEN 1.0::DOUBLE WHEN 'salary' THEN 0.95::DOUBLE WHEN 'mortgage' THEN 0.92::DOUBLE WHEN 'merchant' THEN 0.82::DOUBLE WHEN 'small credit' THEN 0.55::DOUBLE WHEN 'large credit' THEN 0.45::DOUBLE WHEN 'material unknown' THEN 0.40::DOUBLE ELSE 0.50::DOUBLE END AS confidence FROM c)
SELECT *, CASE WHEN economic_class = 'needs_review' THEN 'review' WHEN confidence < 0.7 THEN CASE WHEN category = 'Uncategorized' THEN 'review' ELSE 'auto_visible' END WHEN confidence >= 0.9 THEN 'auto_silent' ELSE 'auto_visible' END AS digest_tier FROM v""",
)(
    lambda l: detect.classify(
        l,
        [
            ("duplicate", F.col("is_duplicate"), "ignore_noise", "Duplicate", 1.0),
            ("salary", (F.col("subcategory") == "1-URGENT") & (F.col("amount") > 0), "income", "Salary", 0.95),
            ("mortgage", (F.col("category") == "BUILDING") & (F.col("amount") < 0), "debt_service", "Mortgage", 0.92),
            ("merchant", F.col("merchant").endswith("7"), "household_spend", "Groceries", 0.82),
        ],
    )
)
query(
    "escalated_inflows",
    ledger_orders,
    """ SELECT id, CASE WHEN amount >= 500 AND economic_class IN ('income', 'needs_review') THEN 'review' ELSE 'auto_visible' END AS digest_tier, CAST(CASE WHEN amount >= 500 AND economic_class IN ('income', 'needs_review') THEN least(confidence, 0.69) ELSE confidence END AS DOUBLE) AS confidence FROM ledger""",
)(lambda l: detect.escalate(l.withColumn("digest_tier", F.lit("auto_visible"))).select("id", "digest_tier", "confidence"))
query(
    "review_groups",
    ledger_orders,
    """, g AS (SELECT merchant, count(*) AS n, sum(abs(amount)) AS x, arg_max(id, (abs(amount), -id)) AS transaction_id FROM ledger WHERE confidence < 0.55 GROUP BY merchant)
SELECT merchant, n, CAST(x AS DOUBLE) AS materiality, transaction_id FROM g ORDER BY x DESC, merchant LIMIT 150""",
)(lambda l: detect.review_groups(l, ["merchant"]))
