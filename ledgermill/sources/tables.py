"""The driver's tables as ledgers: `ledger_orders` and `ledger_events` map orders and events onto the transaction schema.

A ledger has id, account_id, txn_date, amount decimal(18,2) (inflow positive), merchant, category, subcategory, economic_class, confidence and is_duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Customers that are broadcast at most. Spark itself would go by the size of their files, and repeated names make those small.
MOST_CUSTOMERS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction for each order; customers are the merchants. The customer side is a dimension: Spark broadcasts it while it has few rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    if customers.count() > MOST_CUSTOMERS:
        customers = customers.hint("merge")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.col("o_totalprice").cast(MONEY)
    economic_class = (
        F.when((status == "F") & (priority == "1-URGENT"), "reimbursement_pass_through")
        .when((status == "F") & (priority == "2-HIGH"), "refund")
        .when(status == "F", "income")
        .when((status == "P") & (priority == "1-URGENT"), "wealth_allocation")
        .when((status == "P") & (priority == "2-HIGH"), "internal_transfer")
        .when((status == "O") & (priority == "1-URGENT"), "debt_service")
        .otherwise("household_spend")
    )
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(status == "F", price).otherwise(-price).cast(MONEY).alias("amount"),
        F.col("c_name").alias("merchant"),
        F.col("c_mktsegment").alias("category"),
        priority.alias("subcategory"),
        economic_class.alias("economic_class"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"),
        (F.col("o_orderkey") % 97 == 0).alias("is_duplicate"),
    )


#: The same ledger for DuckDB.
LEDGER_ORDERS_SQL = """
ledger AS (
  SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS txn_date,
         CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE -CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount,
         c_name AS merchant, c_mktsegment AS category, o_orderpriority AS subcategory,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'reimbursement_pass_through'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'refund'
              WHEN o_orderstatus = 'F' THEN 'income'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'wealth_allocation'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN 'internal_transfer'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'debt_service'
              ELSE 'household_spend' END AS economic_class,
         (o_orderkey % 100) / 100.0 AS confidence, o_orderkey % 97 = 0 AS is_duplicate,
         strftime(o_orderdate, '%Y-%m') AS month
  FROM orders JOIN customer ON o_custkey = c_custkey),
active AS (SELECT * FROM ledger WHERE NOT is_duplicate)"""


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction for each event; users are the accounts, signups and errors flow in."""
    amount = F.col("value").cast(MONEY)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").cast("date").alias("txn_date"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("event_type").isin("signup", "error"), amount).otherwise(-amount).cast(MONEY).alias("amount"),
        F.col("event_type").alias("category"),
    )


LEDGER_EVENTS_SQL = """
ledger AS (
  SELECT event_id AS id, user_id AS account_id, CAST(ts AS DATE) AS txn_date, CAST(ts AS TIMESTAMP) AS ts,
         CAST(CASE WHEN event_type IN ('signup', 'error') THEN CAST(value AS DECIMAL(18,2)) ELSE -CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount,
         event_type AS category
  FROM events)"""


def month_of(date) -> F.Column:
    return F.date_format(date, "yyyy-MM")
