"""Queries of the cascade, its facts, reviews and the income calendar, over orders with texts made from their keys, and SQL by those keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, cascade
from ..sources.tables import table
from .ledger_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ROLES = ("checking", "savings", "credit_card", "wise", "investment", "unknown")
#: What a row says, by its key modulo the number of these.
PHRASES = (
    "NOTHING KNOWN", "SHARES BOOKED", "BROKERAGE ORDER", "MONEY ADDED", "FROM CURRENT ACCOUNT", "INTEREST PAID", "CASH DEPOSIT", "BUILDING DEPOT", "MULTI CURRENCY WALLET", "SOCIAL BENEFIT CHILD BENEFIT", "SOCIAL BENEFIT", "COMPENSATION PLAN",
    "EMPLOYER EXPENSES", "REFUND", "MORTGAGE", "ACCOUNT FEE", "CREDIT INTEREST", "DEBIT INTEREST", "CREDIT CARD", "CASH WITHDRAWAL", "SAVINGS", "PAYMENT REQUEST", "EXPENSE CLAIM", "SUPERMARKET", "PAYMENT PROCESSOR", "SEPA OVERBOEKING", "PAYMENT RECEIVED", "PARTNER /INV/", "SALARY",
)


def bank_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    # Halves of a cent go where the nearest double lies, as in the SQL, whose quotient is a double.
    thousandth = (F.round(price.cast("double") / 1000 * 100) / 100).cast("decimal(18,2)")
    small = F.when(key % 5 == 0, thousandth).otherwise(price)
    phrase = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (key % len(PHRASES) + 1).cast("int"))
    return o.select(
        key.alias("id"), F.col("o_custkey").alias("account_id"), F.element_at(F.array(*[F.lit(x) for x in ROLES]), (F.col("o_custkey") % len(ROLES) + 1).cast("int")).alias("account_role"), F.when(F.col("o_custkey") % 2 == 0, "checking").otherwise("generic").alias("institution"), F.lit("main").alias("account_name"),
        F.col("o_orderdate").cast("date").alias("txn_date"), F.when(F.col("o_orderstatus") == "F", small).otherwise(-small).cast("decimal(18,2)").alias("amount"), (key % 97 == 0).alias("is_duplicate"), F.lit("PARTY").alias("counterparty_name"),
        F.when(key % 7 == 0, F.sha2((F.col("o_custkey") % 10).cast("string"), 256)).alias("counterparty_account_hash"), F.concat_ws(" ", F.lit("NAME:"), phrase).alias("description"), F.concat(F.lit("SHOP "), F.col("o_custkey") % 13).alias("merchant"), F.lit("").alias("reference"),
        F.when(key % 2 == 0, "USD").otherwise("EUR").alias("native_currency"), F.lit(None).cast("string").alias("source_currency"), F.lit(None).cast("string").alias("target_currency"),
    )


_LEDGER = f"""WITH l AS (SELECT o_orderkey AS id, o_custkey AS account_id, [{", ".join(f"'{x}'" for x in ROLES)}][o_custkey % {len(ROLES)} + 1] AS role, CASE WHEN o_custkey % 2 = 0 THEN 'checking' ELSE 'generic' END AS institution, CAST(o_orderdate AS DATE) AS d,
  [{", ".join(f"'{x}'" for x in PHRASES)}][o_orderkey % {len(PHRASES)} + 1] AS p, o_orderkey % 97 = 0 AS is_duplicate, o_orderkey % 2 = 0 AS usd, CAST(CASE WHEN o_orderstatus = 'F' THEN s ELSE -s END AS DECIMAL(18,2)) AS amount, o_custkey,
  CASE WHEN o_orderkey % 7 = 0 THEN sha256(CAST(o_custkey % 10 AS VARCHAR)) END AS other, 'SHOP ' || CAST(o_custkey % 13 AS VARCHAR) AS merchant
  FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) / 1000 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS s FROM orders))
"""


def query(name: str, sql: str | None = None):
    def add(make: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plain(make(bank_ledger(spark, sf_dir)))
        if sql is not None:
            ORACLE_SQL[name] = _LEDGER + sql
        return make

    return add


#: What each row must become: the step's name by role, phrase, sign and size alone.
_STEP = """CASE WHEN is_duplicate THEN 'duplicate'
 WHEN amount > 0 AND p IN ('PARTNER /INV/', 'EMPLOYER EXPENSES') THEN 'invoice reimbursement'
 WHEN role = 'credit_card' AND amount > 0 AND p = 'PAYMENT RECEIVED' THEN 'card payment' WHEN role = 'credit_card' AND amount > 0 THEN 'card credit' WHEN role = 'credit_card' THEN 'card spend'
 WHEN role = 'wise' AND amount < 0 AND p = 'SHARES BOOKED' THEN 'wallet shares' WHEN role = 'wise' AND amount < 0 AND p = 'BROKERAGE ORDER' THEN 'wallet to broker'
 WHEN role = 'wise' AND amount >= 1000 AND usd AND p = 'MONEY ADDED' AND (month(d) IN (3, 4) OR month(d) = 5 AND day(d) <= 15) THEN 'wallet stock proceeds' WHEN role = 'wise' AND amount > 0 THEN 'wallet top-up' WHEN role = 'wise' AND amount < 0 THEN 'wallet to person'
 WHEN role = 'savings' AND p = 'FROM CURRENT ACCOUNT' THEN 'savings transfer' WHEN role = 'savings' AND amount > 0 AND p IN ('INTEREST PAID', 'CREDIT INTEREST', 'DEBIT INTEREST') THEN 'savings interest'
 WHEN amount > 0 AND p = 'CASH DEPOSIT' THEN 'cash deposit' WHEN amount > 0 AND p = 'BUILDING DEPOT' THEN 'building depot' WHEN p = 'MULTI CURRENCY WALLET' THEN 'own wallet'
 WHEN amount > 0 AND p = 'SOCIAL BENEFIT CHILD BENEFIT' THEN 'child benefit' WHEN amount > 0 AND p = 'SOCIAL BENEFIT' THEN 'benefit' WHEN amount >= 1000 AND usd AND p = 'COMPENSATION PLAN' THEN 'stock compensation'
 WHEN amount > 0 AND p = 'REFUND' THEN 'refund' WHEN role = 'investment' THEN 'investment account' WHEN p = 'BROKERAGE ORDER' THEN 'investment word' WHEN p = 'MORTGAGE' THEN 'mortgage'
 WHEN amount < 0 AND p = 'ACCOUNT FEE' THEN 'bank fee' WHEN amount > 0 AND p = 'CREDIT INTEREST' THEN 'credit interest' WHEN amount < 0 AND p = 'DEBIT INTEREST' THEN 'bank interest' WHEN amount < 0 AND p = 'CREDIT CARD' THEN 'unknown card spend'
 WHEN amount < 0 AND p = 'CASH WITHDRAWAL' THEN 'cash withdrawal' WHEN p = 'SAVINGS' THEN 'savings word' WHEN amount > 0 AND p = 'PAYMENT REQUEST' THEN 'payment request received' WHEN p = 'PAYMENT REQUEST' THEN 'payment request paid'
 WHEN amount > 0 AND p = 'EXPENSE CLAIM' THEN 'reimbursement word' WHEN amount > 0 AND p = 'SUPERMARKET' THEN 'merchant credit' WHEN amount > 0 AND amount < 500 THEN 'small credit' WHEN amount > 0 THEN 'large credit' WHEN p = 'SUPERMARKET' THEN 'merchant'
 WHEN amount < 0 AND p = 'PAYMENT PROCESSOR' THEN 'payment processor' WHEN amount < 0 AND p = 'SEPA OVERBOEKING' THEN 'bank transfer' WHEN abs(amount) >= 250 THEN 'material unknown' ELSE 'other' END"""
#: What each step says: class, category, subcategory, confidence.
_SAYS = {
    "duplicate": ("ignore_noise", "Duplicate", "", 1.0), "invoice reimbursement": ("reimbursement_pass_through", "Reimbursements", "Company Expense", 0.94), "card payment": ("internal_transfer", "Card Settlement", "", 0.9), "card credit": ("refund", "Other", "", 0.76),
    "card spend": ("household_spend", "Other", "Card Spend", 0.62), "wallet shares": ("wealth_allocation", "Investments", "RSU Settlement", 0.84), "wallet to broker": ("wealth_allocation", "Investments", "Wise to Broker", 0.9), "wallet stock proceeds": ("income", "Equity Compensation", "RSU", 0.88),
    "wallet top-up": ("internal_transfer", "Inter-account Transfers", "Wise", 0.84), "wallet to person": ("household_spend", "Other", "Personal Transfer", 0.66), "savings transfer": ("internal_transfer", "Inter-account Transfers", "Savings", 0.92), "savings interest": ("income", "Interest", "Savings", 0.9),
    "cash deposit": ("internal_transfer", "Cash Deposit", "", 0.82), "building depot": ("refund", "Home and Furniture", "Home Improvement", 0.82), "own wallet": ("internal_transfer", "Inter-account Transfers", "Wise", 0.84), "child benefit": ("income", "Benefits", "Child Benefit", 0.94),
    "benefit": ("income", "Benefits", "Government Benefit", 0.88), "stock compensation": ("income", "Equity Compensation", "RSU", 0.72), "refund": ("refund", "Uncategorized", "", 0.84), "investment account": ("wealth_allocation", "Investments", "", 0.78), "investment word": ("wealth_allocation", "Investments", "", 0.9),
    "mortgage": ("debt_service", "Housing", "Mortgage", 0.92), "bank fee": ("household_spend", "Subscriptions", "Account Fees", 0.84), "credit interest": ("income", "Interest", "", 0.8), "bank interest": ("household_spend", "Banking and Fees", "Interest", 0.78), "unknown card spend": ("household_spend", "Unknown Card Spend", "", 0.72),
    "cash withdrawal": ("household_spend", "Cash Withdrawal", "", 0.86), "savings word": ("internal_transfer", "Inter-account Transfers", "Savings", 0.74), "payment request received": ("reimbursement_pass_through", "Reimbursements", "Payment Request", 0.72), "payment request paid": ("household_spend", "Other", "Payment Request", 0.64),
    "reimbursement word": ("reimbursement_pass_through", "Reimbursements", "Other", 0.72), "merchant credit": ("refund", "Groceries", "", 0.7), "small credit": ("refund", "Other", "Misc", 0.62), "large credit": ("needs_review", "Uncategorized", "", 0.45), "merchant": ("household_spend", "Groceries", "", 0.82),
    "payment processor": ("household_spend", "Other", "Payment Processor", 0.62), "bank transfer": ("household_spend", "Other", "Bank Transfer", 0.6), "material unknown": ("needs_review", "Uncategorized", "", 0.4), "other": ("household_spend", "Other", "", 0.58),
}
_VALUES = ", ".join(f"('{k}', '{a}', '{b}', '{c}', {d}::DOUBLE)" for k, (a, b, c, d) in _SAYS.items())
_CASCADE = f""", v(rule, economic_class, category, subcategory, confidence) AS (VALUES {_VALUES}), s AS (SELECT *, {_STEP} AS rule FROM l),
a AS (SELECT id, rule, economic_class, category, subcategory, confidence, CASE WHEN economic_class = 'needs_review' THEN 'review' WHEN confidence < 0.7 THEN CASE WHEN category = 'Uncategorized' THEN 'review' ELSE 'auto_visible' END WHEN confidence >= 0.9 THEN 'auto_silent' ELSE 'auto_visible' END AS digest_tier FROM s JOIN v USING (rule))
"""
query("cascade", _CASCADE + " SELECT * FROM a")(lambda l: cascade.classify_ledger(cascade.with_texts(l)))
query(
    "cascade_salaries",
    """, w AS (SELECT *, CASE WHEN month(d) = 12 THEN day(d) BETWEEN 18 AND 26 WHEN isodow(make_date(year(d), month(d), 25)) = 6 THEN day(d) BETWEEN 24 AND 25 WHEN isodow(make_date(year(d), month(d), 25)) = 7 THEN day(d) BETWEEN 25 AND 26 ELSE day(d) BETWEEN 24 AND 26 END AS pay FROM l),
r AS (SELECT *, p = 'SALARY' AS named, month(d) = 2 AND p = 'SALARY' AND amount >= 15000 AS bonus, institution || ':' || coalesce('account:' || other, 'merchant:SHOP') AS payer FROM w WHERE NOT is_duplicate AND amount > 0 AND role = 'checking' AND (p = 'SALARY' OR pay AND amount >= 1500 AND p NOT IN ('SAVINGS', 'PAYMENT REQUEST'))),
g AS (SELECT payer, count(*) FILTER (WHERE NOT bonus) AS regular FROM r GROUP BY payer HAVING count(DISTINCT strftime(d, '%Y-%m')) >= 2 OR bool_or(named)),
m AS (SELECT payer, list_sort(list(amount))[len(list(amount)) // 2 + 1] AS median FROM r JOIN g USING (payer) WHERE NOT bonus OR regular = 0 GROUP BY payer)
SELECT id, bonus FROM r JOIN m USING (payer) WHERE abs(amount - median) <= greatest(250, median * 0.12) OR named OR bonus""",
)(lambda l: cascade.salary_rows(cascade.with_texts(l)))
_PAIR = """, x AS (SELECT *, CAST(abs(amount) * 100 AS BIGINT) AS cents FROM l WHERE NOT is_duplicate AND amount <> 0)"""
query(
    "cascade_transfer_edges",
    _PAIR
    + """ SELECT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, abs(date_diff('day', a.d, b.d)) AS days, 1 AS priority, CAST(-a.amount AS DOUBLE) AS falling, CAST(a.amount AS DOUBLE) AS amount FROM x a JOIN x b ON a.cents = b.cents AND a.amount > 0 AND b.amount < 0 AND a.account_id <> b.account_id AND abs(date_diff('day', a.d, b.d)) <= 400
WHERE a.role = 'investment' OR b.role = 'investment' OR a.p = 'BROKERAGE ORDER' OR b.p = 'BROKERAGE ORDER' OR (a.role <> 'credit_card' AND b.role <> 'credit_card') OR a.p = 'SAVINGS' OR b.p = 'SAVINGS'""",
)(lambda l: cascade.transfer_edges(cascade.with_texts(l), days=400))
query(
    "cascade_refunds",
    """, w AS (SELECT i.id, o.id AS outflow_id, o.d, CASE WHEN o.p = 'SUPERMARKET' THEN NULL END AS category FROM l i JOIN l o ON NOT i.is_duplicate AND NOT o.is_duplicate AND i.amount > 0 AND o.amount < 0 AND i.p = 'REFUND' AND o.d <= i.d AND date_diff('day', o.d, i.d) <= 120 AND abs(-o.amount - i.amount) <= greatest(10, i.amount * 0.2)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, outflow_id) AS n FROM w) SELECT id, outflow_id, 'Uncategorized' AS category FROM k WHERE n = 1""",
)(lambda l: cascade.refund_rows(cascade.with_texts(l)))
query(
    "review_items",
    _CASCADE
    + """, q AS (SELECT l.*, CASE WHEN other IS NOT NULL THEN 'counterparty|' || other ELSE 'merchant|' || merchant || CASE WHEN amount < 0 THEN '|outflow' ELSE '|inflow' END END AS review_key FROM l JOIN a USING (id)
  WHERE economic_class = 'needs_review' OR digest_tier = 'review' OR confidence < 0.55 OR category = 'Uncategorized' AND abs(amount) >= 100),
g AS (SELECT review_key, count(*) AS n, sum(abs(amount)) AS materiality, arg_max(id, (abs(amount), -id)) AS transaction_id FROM q GROUP BY review_key)
SELECT review_key, n, CAST(materiality AS DOUBLE) AS materiality, transaction_id FROM g ORDER BY materiality DESC, review_key LIMIT 150""",
)(lambda l: cascade.review_items(texts := cascade.with_texts(l), cascade.classify_ledger(texts)))


def _decided(l: DataFrame) -> DataFrame:
    rows = l.where("id % 11 = 0").select(F.col("id").alias("transaction_id"), F.when(F.col("id") % 2 == 0, "internal_transfer").otherwise("household_spend").alias("economic_class"), F.lit("Chosen").alias("category"))
    return cascade.rules_from_reviews(cascade.with_texts(l), rows).select("rule_id", "scope", "transaction_id", "counterparty_account_hash", "merchant_contains", "direction", "economic_class").fillna("").fillna(-1)


query(
    "rules_from_reviews",
    """, s AS (SELECT *, CASE WHEN other IS NOT NULL THEN 'counterparty' WHEN id % 2 = 0 THEN 'transaction' ELSE 'merchant' END AS scope FROM l WHERE id % 11 = 0)
SELECT id AS rule_id, scope, CASE scope WHEN 'transaction' THEN id ELSE -1 END AS transaction_id, CASE scope WHEN 'counterparty' THEN other ELSE '' END AS counterparty_account_hash, CASE scope WHEN 'merchant' THEN merchant ELSE '' END AS merchant_contains,
 CASE WHEN scope = 'transaction' THEN '' WHEN amount < 0 THEN 'out' ELSE 'in' END AS direction, CASE WHEN id % 2 = 0 THEN 'internal_transfer' ELSE 'household_spend' END AS economic_class FROM s""",
)(_decided)


def _income(l: DataFrame) -> DataFrame:
    kind = F.when(F.col("id") % 3 == 0, "Cash Bonus").otherwise("Salary")
    stock = F.col("id") % 17 == 0
    return l.where("not is_duplicate and amount > 0 and account_role = 'checking'").select("id", "txn_date", "amount", F.when(stock, "Equity Compensation").otherwise("Income").alias("category"), F.when(stock, "RSU").otherwise(kind).alias("subcategory"))


_INCOME = """, i AS (SELECT id, d, amount, id % 17 = 0 AS stock, CASE WHEN id % 3 = 0 THEN 'Cash Bonus' ELSE 'Salary' END AS kind, date_trunc('month', d) AS m FROM l WHERE NOT is_duplicate AND amount > 0 AND role = 'checking'),
x AS (SELECT min(d) AS first, max(d) AS latest FROM l WHERE NOT is_duplicate), c AS (SELECT first, latest, CAST(CASE WHEN day(latest) >= 28 THEN date_trunc('month', latest) ELSE date_trunc('month', latest) - to_months(1) END AS DATE) AS last FROM x),
t AS (SELECT CAST(m AS DATE) AS m, sum(amount) AS total, max(id) AS top FROM i WHERE NOT stock AND kind = 'Salary' GROUP BY 1),
"""
query(
    "expected_salaries",
    _INCOME
    + """o AS (SELECT list_sort(list(total))[len(list(total)) // 2 + 1] AS expected FROM t WHERE month(m) <> 2 HAVING count(*) >= 2),
s AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(m) FROM t) AS TIMESTAMP), CAST((SELECT last FROM c) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m),
e AS (SELECT m, CAST(expected AS DECIMAL(18,2)) AS expected, greatest(750.0::DOUBLE, CAST(CAST(expected AS DECIMAL(18,2)) AS DOUBLE) * 0.18::DOUBLE) AS tolerance FROM s, o WHERE NOT (month(m) = 2 AND year(m) >= 1994))
SELECT strftime(e.m, '%Y-%m') AS month, CAST(CASE WHEN month(e.m) = 12 THEN make_date(year(e.m), 12, 21) WHEN isodow(make_date(year(e.m), month(e.m), 25)) = 6 THEN make_date(year(e.m), month(e.m), 24) WHEN isodow(make_date(year(e.m), month(e.m), 25)) = 7 THEN make_date(year(e.m), month(e.m), 26) ELSE make_date(year(e.m), month(e.m), 25) END AS VARCHAR) AS expected_date,
 CAST(expected AS DOUBLE) AS expected_amount, round(tolerance, 6) AS tolerance, coalesce(CAST(total AS DOUBLE) + tolerance >= CAST(expected AS DOUBLE), false) AS observed FROM e LEFT JOIN t ON t.m = e.m""",
)(lambda l: calendar.observed(calendar.expected_salaries(_income(l), l.where("not is_duplicate"), first_month="1970-01", skipped_since=1994), _income(l)).select("month", F.col("expected_date").cast("string").alias("expected_date"), F.col("expected_amount").cast("double").alias("expected_amount"), F.round("tolerance", 6).alias("tolerance"), (F.col("status") == "observed").alias("observed")))
query(
    "expected_bonuses",
    _INCOME
    + """b AS (SELECT year(d) AS y, amount FROM i WHERE NOT stock AND kind = 'Cash Bonus' AND month(d) = 2), o AS (SELECT list_sort(list(amount))[len(list(amount)) // 2 + 1] AS expected, min(y) AS y FROM b HAVING count(*) > 0),
s AS (SELECT unnest(generate_series(y, year((SELECT last FROM c)))) AS y, expected FROM o), e AS (SELECT y, CAST(expected AS DOUBLE) AS expected, greatest(5000.0::DOUBLE, CAST(expected AS DOUBLE) * 0.25::DOUBLE) AS tolerance FROM s WHERE (SELECT last FROM c) >= make_date(y, 2, 1))
SELECT CAST(y AS VARCHAR) || '-02' AS month, expected AS expected_amount, round(tolerance, 6) AS tolerance, EXISTS (SELECT 1 FROM b WHERE b.y = e.y AND abs(CAST(b.amount AS DOUBLE) - expected) <= tolerance) AS observed FROM e""",
)(lambda l: calendar.observed(calendar.expected_bonuses(_income(l), l.where("not is_duplicate"), first_year=1900), _income(l)).select("month", F.col("expected_amount").cast("double").alias("expected_amount"), F.round("tolerance", 6).alias("tolerance"), (F.col("status") == "observed").alias("observed")))
query(
    "expected_stock",
    _INCOME
    + """s AS (SELECT unnest(generate_series(year(first), year(latest))) AS y, latest FROM c), e AS (SELECT y FROM s WHERE latest >= make_date(y, 4, 30) AND EXISTS (SELECT 1 FROM i WHERE stock))
SELECT CAST(y AS VARCHAR) || '-04' AS month, EXISTS (SELECT 1 FROM i WHERE stock AND year(d) = y AND (month(d) IN (3, 4) OR month(d) = 5 AND day(d) <= 15)) AS observed FROM e""",
)(lambda l: calendar.observed(calendar.expected_stock(_income(l), l.where("not is_duplicate"), first_year=1900), _income(l)).select("month", (F.col("status") == "observed").alias("observed")))
QUERIES["classify_all"] = lambda spark, sf_dir: plain(cascade.classify_all(bank_ledger(spark, sf_dir)))
