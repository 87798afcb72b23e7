"""Queries of statement texts made from the orders, and the SQL of what they must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import statements
from ..sources.tables import table
from .ledger_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PER_TEXT = 250
_OWN, _OTHER = "NL20 ABNA 0123 4567 89", "NL91ABNA0417164300"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / PER_TEXT).cast("long").alias("number"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), (F.col("o_orderstatus") == "F").alias("inward"))


def _european(x: Column) -> Column:
    return F.translate(F.format_number(x, 2), ",.", ".,")


def _texts(rows: DataFrame, head: Column, line: Column) -> DataFrame:
    """(path, text): the heads and the lines of each number's orders, by key."""
    made = rows.withColumns({"head": head, "line": line}).groupBy("number").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("lines"))
    return made.select(F.concat(F.lit("t"), "number").alias("path"), F.concat_ws("\n", "head", F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd numbers have no heads; every second row has two lines of details, every fifth a page's furniture among them."""
    rows = _orders(spark, sf_dir)
    head = F.when(F.col("number") % 2 == 0, F.concat(F.lit("Afschrift Creditcard\nOvereenkomstnummer  1234 5678 "), F.lpad(F.col("number").cast("string"), 4, "0"), F.lit("\n\nPeriode 01-02-1996  t/m 28-02-1996\nOp 05-03-1996 schrijven wij 1.234,56 euro af\n"))).otherwise("Saldo vorige maand")
    kind = F.when(F.col("inward"), F.when(F.col("k") % 4 == 0, "Incasso").otherwise("Ontvangst")).otherwise("Betaling")
    line = F.concat(F.lit("  "), F.date_format("d", "dd-MM-yyyy"), F.lit(" Shop  "), F.col("c"), F.lit("    "), kind, F.lit("   "), F.when(F.col("k") % 7 == 0, "+ ").otherwise(""), _european(F.col("price")))
    more = F.concat(F.when(F.col("k") % 5 == 0, "\nPagina 2 van 3\n\n").otherwise(""), F.when(F.col("k") % 2 == 0, F.concat(F.lit("\n   order "), F.col("k"), F.lit("\n  kaart 12  "))).otherwise(""))
    return _texts(rows, head, F.concat(line, more))


def bank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts stand under one of two headers, whose places differ by text; every third text has none, so the usual place holds."""
    rows = _orders(spark, sf_dir)
    offset = F.when(F.col("number") % 3 == 0, 95).otherwise(80 + F.col("number") % 3)
    header = F.when(F.col("number") % 3 == 0, "").otherwise(F.concat(F.rpad(F.lit("Boekdatum  Omschrijving"), 60, " "), F.rpad(F.lit("Bedrag af"), (20 + F.col("number") % 3).cast("int"), " "), F.lit("Bedrag bij")))
    head = F.concat(F.lit("Rekeningafschrift\nDatum 15-03-"), F.lit(1996) + F.col("number") % 3, F.lit(f" blad 1\n{_OWN}\nVorig saldo   Nieuw saldo\nper vorige datum\n  "), _european(F.lit(1000) + F.col("number")), F.lit(" +/CREDIT   2.500,75 +/CREDIT\n"), header)
    month = F.pmod(F.month("d") - 1, F.lit(12)) + 1
    left = F.concat(F.lit(" "), F.lpad(F.dayofmonth("d").cast("string"), 2, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("  Shop "), F.col("c"))
    place = F.when(F.col("inward"), F.greatest(offset - 5 + F.col("k") % 9, F.lit(40))).otherwise(F.lit(50) + F.col("k") % 20).cast("int")
    more = F.when(F.col("k") % 3 == 0, F.concat(F.lit(f"\n   order {_OTHER} "), F.col("k"), F.lit("\nPagina 1\nBTW nr. 1"))).otherwise("")
    day_fits = ~((F.month("d") == 2) & (F.dayofmonth("d") == 29))
    return _texts(rows.where(day_fits), head, F.concat(F.rpad(left, place, " "), _european(F.col("price")), more))


def overview_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loan part a row; two mortgages a text."""
    rows = _orders(spark, sf_dir)
    head = F.concat(F.lit("FINANCIEEL  JAAROVERZICHT "), F.lit(2001) + F.col("number") % 5, F.lit(f"\n{_OWN} saldo"), F.when(F.col("number") % 2 == 0, "\n").otherwise(" "), F.lit(" 1.000,50   "), _european(F.lit(3000) + F.col("number")), F.lit("\nHypotheeknummer  12.34.567"))
    second = F.when(F.col("k") % 100 == 50, "Hypotheeknummer 99.1\n").otherwise("")
    line = F.concat(second, F.lit("Leningdeelnr: "), F.col("k"), F.lit("  "), _european(F.col("price")), F.lit("  -"), _european((F.floor(F.col("price")) / 2).cast("decimal(18,2)")), F.when(F.col("k") % 3 == 0, "  12,34").otherwise(""))
    return _texts(rows, head, line)


_O = """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 250 AS number, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus = 'F' AS inward FROM orders)
"""
QUERIES["statement_card_rows"] = lambda spark, sf_dir: plain(
    statements.card_rows(card_texts(spark, sf_dir)).select("path", "account_name", F.col("txn_date").cast("string").alias("txn_date"), "amount", "counterparty_name", "description", "kind", F.col("period_end").cast("string").alias("period_end"), "settlement_amount").fillna("", ["period_end"]).fillna(-1, ["settlement_amount"])
)
ORACLE_SQL["statement_card_rows"] = (
    _O
    + """SELECT 't' || number AS path, CASE WHEN number % 2 = 0 THEN '12345678' || lpad(CAST(number AS VARCHAR), 4, '0') ELSE 'ING credit card' END AS account_name, CAST(d AS VARCHAR) AS txn_date, CAST(CASE WHEN inward THEN price ELSE -price END AS DOUBLE) AS amount, 'Shop ' || c AS counterparty_name,
 'Shop ' || c || CASE WHEN k % 2 = 0 THEN ' order ' || k || ' kaart 12' ELSE '' END AS description, CASE WHEN NOT inward THEN 'Betaling' WHEN k % 4 = 0 THEN 'Incasso' ELSE 'Ontvangst' END AS kind, CASE WHEN number % 2 = 0 THEN '1996-02-28' ELSE '' END AS period_end, CASE WHEN number % 2 = 0 THEN 1234.56::DOUBLE ELSE -1 END AS settlement_amount FROM o"""
)
QUERIES["statement_bank_rows"] = lambda spark, sf_dir: plain(
    statements.bank_rows(bank_texts(spark, sf_dir), cutoff="1998-02-10").select("path", "account_name", F.col("txn_date").cast("string").alias("txn_date"), "amount", "amount_column", "counterparty_account", "description")
)
ORACLE_SQL["statement_bank_rows"] = (
    _O
    + """, y AS (SELECT *, make_date(1996 + number % 3 - CASE WHEN month(d) > 9 THEN 1 ELSE 0 END, month(d), day(d)) AS t FROM o WHERE NOT (month(d) = 2 AND day(d) = 29))
SELECT 't' || number AS path, 'NL20ABNA0123456789' AS account_name, CAST(t AS VARCHAR) AS txn_date, CAST(CASE WHEN inward THEN price ELSE -price END AS DOUBLE) AS amount, CASE WHEN inward THEN 'credit' ELSE 'debit' END AS amount_column, CASE WHEN k % 3 = 0 THEN 'NL91ABNA0417164300' ELSE '' END AS counterparty_account,
 'Shop ' || c || CASE WHEN k % 3 = 0 THEN ' order NL91ABNA0417164300 ' || k ELSE '' END AS description FROM y WHERE t < DATE '1998-02-10'"""
)
QUERIES["statement_bank_anchors"] = lambda spark, sf_dir: plain(statements.bank_anchors(bank_texts(spark, sf_dir)).select("path", "account_name", "role", F.col("observation_date").cast("string").alias("observation_date"), "balance_type", "balance", "confidence"))
ORACLE_SQL["statement_bank_anchors"] = (
    _O
    + """, t AS (SELECT DISTINCT number FROM o WHERE NOT (month(d) = 2 AND day(d) = 29))
SELECT 't' || number AS path, 'NL20ABNA0123456789' AS account_name, 'checking' AS role, (1996 + number % 3) || '-03-15' AS observation_date, kind AS balance_type, CASE WHEN kind = 'opening_pdf_statement' THEN (1000 + number)::DOUBLE ELSE 2500.75::DOUBLE END AS balance, sure AS confidence
FROM t, (VALUES ('opening_pdf_statement', 0.92::DOUBLE), ('closing_pdf_statement', 0.96::DOUBLE)) a(kind, sure)"""
)
QUERIES["statement_overview_anchors"] = lambda spark, sf_dir: plain(statements.overview_anchors(overview_texts(spark, sf_dir)).select("path", "account_name", "role", F.col("observation_date").cast("string").alias("observation_date"), "balance_type", "balance", "confidence"))
ORACLE_SQL["statement_overview_anchors"] = (
    _O
    + """, n AS (SELECT *, 2001 + number % 5 AS y, CASE WHEN bool_or(k % 100 = 50) OVER (PARTITION BY number ORDER BY k) THEN '99.1' ELSE '12.34.567' END AS mortgage, CAST(floor(price) / 2 AS DECIMAL(18,2)) AS half FROM o),
own AS (SELECT DISTINCT number, y FROM n)
SELECT 't' || number AS path, 'NL20ABNA0123456789' AS account_name, 'checking' AS role, (y - 1) || '-12-31' AS observation_date, 'year_end' AS balance_type, 1000.5::DOUBLE AS balance, 0.96::DOUBLE AS confidence FROM own
UNION ALL SELECT 't' || number, 'NL20ABNA0123456789', 'checking', y || '-12-31', 'year_end', (3000 + number)::DOUBLE, 0.98::DOUBLE FROM own
UNION ALL SELECT 't' || number, mortgage || ':' || k, 'mortgage', (y - 1) || '-12-31', 'year_end', price::DOUBLE, 0.96::DOUBLE FROM n
UNION ALL SELECT 't' || number, mortgage || ':' || k, 'mortgage', y || '-12-31', 'year_end', -half::DOUBLE, 0.98::DOUBLE FROM n
UNION ALL SELECT 't' || number, mortgage || ':' || k, 'mortgage', y || '-12-31', 'paid_interest', 12.34::DOUBLE, 0.9::DOUBLE FROM n WHERE k % 3 = 0"""
)
