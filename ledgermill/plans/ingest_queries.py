"""Queries that import the orders, written out as exports in six layouts with copies and unreadable files among them, and the SQL of what must come in."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut, shared_folder
from ..sources import batches, ingest
from ..sources.tables import table
from .ledger_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Orders whose keys have the same thousands are one file; its number modulo 6 is the layout.
PER_FILE = 250
HEADERS = (
    "Datum;Naam / Omschrijving;Rekening;Tegenrekening;Code;Af Bij;Bedrag (EUR);MutatieSoort;Mededelingen",
    '"Date","Name / Description","Account","Counterparty","Code","Debit/credit","Amount (EUR)","Transaction type","Notifications","Resulting balance","Tag"',
    "Boekdatum;Omschrijving;Rekeningnummer;Tegenrekeningnummer;Naam tegenpartij;Bedrag;Valuta",
    None,
    "Date,Account,Counterparty,Amount,Currency,Description",
    "ID,Status,Direction,Created on,Finished on,Source fee amount,Source fee currency,Source name,Source amount (after fees),Source currency,Target name,Target amount (after fees),Target currency,Exchange rate,Reference,Note",
)


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a file has at most PER_FILE orders."""
    o = table(spark, sf_dir, "orders")
    key, price, day = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate").cast("date")
    number = F.floor(key / PER_FILE).cast("long")
    inward = F.col("o_orderstatus") == "F"
    text = price.cast("string")
    comma = F.replace(text, F.lit("."), F.lit(","))
    dotted = F.translate(F.format_number(price, 2), ",.", ".,")
    name, account = F.concat(F.lit("Shop "), F.col("o_custkey")), F.concat(F.lit("ACC"), F.col("o_custkey") % 7)
    note, iso = F.concat(F.lit("order "), key), F.date_format(day, "yyyy-MM-dd")
    join = lambda sep, *x: F.concat_ws(sep, *[F.lit(v) if isinstance(v, str) else v for v in x])
    quoted = lambda *x: F.concat(F.lit('"'), join('","', *x), F.lit('"'))
    signed = lambda x: F.concat(F.when(inward, "").otherwise("-"), x)
    rows = (
        join(";", iso, name, account, "", "GT", F.when(inward, "Bij").otherwise("Af"), dotted, "x", note),
        quoted(F.date_format(day, "yyyyMMdd"), name, account, "", "GT", F.when(inward, "Credit").otherwise("Debit"), comma, "x", note, comma, ""),
        join(";", F.date_format(day, "d-M-yyyy"), note, account, "", name, signed(comma), "EUR"),
        join("\t", F.concat(F.lit("1000"), F.lpad((F.col("o_custkey") % 7).cast("string"), 3, "0")), "EUR", F.date_format(day, "yyyyMMdd"), comma, comma, F.date_format(day, "yyyyMMdd"), signed(comma), note),
        join(",", iso, account, F.concat(F.lit("Café €"), F.col("o_custkey")), signed(text), "EUR", note, "spilled"),  # a cell too many
        join(",", note, "COMPLETED", F.when(inward, "IN").otherwise("OUT"), iso, iso, "0", "EUR", name, text, F.when(inward, "USD").otherwise("EUR"), name, text, F.when(inward, "EUR").otherwise("USD"), "1.0", "", ""),
    )
    layout = (number % len(HEADERS)).cast("int")
    lines = o.select(number.alias("number"), layout.alias("layout"), key.alias("key"), F.element_at(F.array(*rows), layout + 1).alias("line"))
    files = lines.groupBy("number", "layout").agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["line"]), "\r\n")
    head = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), F.col("layout") + 1)
    whole = F.concat_ws("\n", head, body)
    windows = F.encode(F.replace(whole, F.lit("€"), F.lit("\x80")), "ISO-8859-1")  # the euro sign of code page 1252
    content = F.when(F.col("layout") == 4, windows).otherwise(F.encode(whole, "UTF-8"))
    own = files.select(F.concat(F.lit("in/checking/a"), F.lpad(F.col("number").cast("string"), 8, "0"), F.lit(".csv")).alias("path"), content.alias("content"), "number")
    third = own.where("number % 3 = 0")
    copies = third.select(F.concat(F.lit("in/savings/c"), F.col("number"), F.lit(".csv")).alias("path"), "content")
    longer = third.select(F.concat(F.lit("in/savings/d"), F.col("number"), F.lit(".csv")).alias("path"), F.concat("content", F.lit(b"\n\n")).alias("content"))
    odd = spark.createDataFrame([("in/x.pdf", bytearray(b"%PDF")), ("in/broken.csv", bytearray(b"Date,Account,Amount\n2024-01-05,A,1.00\nsoon,A,2.00\n")), ("in/empty.csv", bytearray(b"\n"))], "path string, content binary")
    return own.select("path", "content").union(copies).union(longer).union(odd)


def query(name: str, sql: str):
    def add(make: Callable[[ingest.Imported], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plain(make(ingest.import_files(export_files(spark, sf_dir))))
        ORACLE_SQL[name] = _ROWS + sql
        return make

    return add


_ROWS = """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 250 AS number, o_orderkey // 250 % 6 AS layout, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus = 'F' AS inward, CAST(o_orderdate AS DATE) AS day, o_custkey AS c FROM orders),
f AS (SELECT DISTINCT number, layout, 'in/checking/a' || lpad(CAST(number AS VARCHAR), 8, '0') || '.csv' AS path FROM o),
t AS (SELECT o.*, path, CASE layout WHEN 0 THEN 'checking' WHEN 1 THEN 'checking' WHEN 2 THEN 'booked' WHEN 3 THEN 'booked' WHEN 4 THEN 'generic' ELSE 'wallet' END AS institution,
  CASE layout WHEN 3 THEN '1000' || lpad(CAST(c % 7 AS VARCHAR), 3, '0') WHEN 5 THEN 'wallet' ELSE 'ACC' || CAST(c % 7 AS VARCHAR) END AS account_name,
  CASE layout WHEN 3 THEN NULL WHEN 4 THEN 'Café €' || CAST(c AS VARCHAR) ELSE 'Shop ' || CAST(c AS VARCHAR) END AS counterparty_name,
  CASE layout WHEN 0 THEN 'Shop ' || CAST(c AS VARCHAR) || ' order ' || CAST(k AS VARCHAR) WHEN 1 THEN 'Shop ' || CAST(c AS VARCHAR) || ' order ' || CAST(k AS VARCHAR) WHEN 5 THEN '' WHEN 4 THEN 'order ' || CAST(k AS VARCHAR) || ' spilled' ELSE 'order ' || CAST(k AS VARCHAR) END AS description,
  CASE WHEN layout = 5 THEN 'order ' || CAST(k AS VARCHAR) END AS reference FROM o JOIN f USING (number, layout)),
u AS (SELECT *, false AS is_duplicate FROM t UNION ALL SELECT * REPLACE ('in/savings/d' || CAST(number AS VARCHAR) || '.csv' AS path), true FROM t WHERE number % 3 = 0)
"""
query(
    "import_transactions",
    """SELECT path, institution, account_name, CAST(day AS VARCHAR) AS txn_date, CAST(CASE WHEN inward THEN price ELSE -price END AS DOUBLE) AS amount, coalesce(counterparty_name, '') AS counterparty_name, description, coalesce(reference, '') AS reference, is_duplicate FROM u""",
)(lambda x: x.transactions.select("path", "institution", "account_name", F.col("txn_date").cast("string").alias("txn_date"), "amount", *[F.coalesce(c, F.lit("")).alias(c) for c in ("counterparty_name", "description", "reference")], "is_duplicate"))
query(
    "import_files",
    """SELECT path, 'imported' AS status, count(*) AS n_rows, '' AS error FROM u GROUP BY path
UNION ALL SELECT 'in/savings/c' || CAST(number AS VARCHAR) || '.csv', 'duplicate_file', -1, '' FROM f WHERE number % 3 = 0
UNION ALL VALUES ('in/x.pdf', 'unsupported', -1, ''), ('in/broken.csv', 'failed', -1, 'row 3: no readable date'), ('in/empty.csv', 'imported', 0, '')""",
)(lambda x: x.files.select("path", "status", F.coalesce("n_rows", F.lit(-1)).alias("n_rows"), F.coalesce("error", F.lit("")).alias("error")))
query(
    "import_accounts",
    """SELECT institution, account_name, CASE WHEN bool_or(NOT is_duplicate) THEN 'checking' ELSE 'savings' END AS role FROM u GROUP BY institution, account_name""",
)(lambda x: x.accounts.select("institution", "account_name", "role"))
query(
    "import_balances",
    """, b AS (SELECT path, k, price, layout, unnest(CASE layout WHEN 1 THEN ['resulting_balance'] ELSE ['opening_balance', 'closing_balance'] END) AS balance_type FROM u WHERE layout IN (1, 3))
SELECT path, balance_type, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM b GROUP BY path, balance_type""",
)(lambda x: x.balances.groupBy("path", "balance_type").agg(F.count("*").alias("n"), F.sum("balance").cast("decimal(18,2)").alias("total")))
query(
    "import_amount_details",
    """SELECT path, reference, CASE WHEN inward THEN 'EUR' ELSE 'EUR' END AS native_currency, CASE WHEN inward THEN 'USD' ELSE 'EUR' END AS source_currency, CASE WHEN inward THEN 'EUR' ELSE 'USD' END AS target_currency, CAST(CASE WHEN inward THEN price ELSE -price END AS DOUBLE) AS converted_amount, 1.0::DOUBLE AS exchange_rate FROM u WHERE layout = 5 AND inward""",
)(lambda x: x.amount_details.join(x.transactions.select("path", "row_number", "reference"), ["path", "row_number"]).select("path", "reference", "native_currency", "source_currency", "target_currency", "converted_amount", "exchange_rate"))


def spanning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): exports whose notes go over three lines with quotes and separators in them, and whose rows have up to 60 cells too many."""
    o = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    number = F.floor(key / PER_FILE).cast("long")
    note = F.concat(F.lit('"order, '), key, F.lit('\nsaid ""yes""\nto '), F.col("o_custkey"), F.lit('"'))
    more = F.when(key % 3 == 0, F.concat(F.lit(","), F.array_join(F.transform(F.sequence(F.lit(1), (key % 60 + 1).cast("int")), lambda i: F.concat(F.lit("m"), i)), ","))).otherwise("")
    line = F.concat_ws(",", F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.lit("ACC1"), F.lit("Shop"), price.cast("string"), F.lit("EUR"), F.when(key % 2 == 0, note).otherwise(F.lit("plain")))
    rows = o.select(number.alias("number"), "o_orderkey", F.concat(line, more).alias("line")).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("rows"))
    whole = F.concat_ws("\n", F.lit(HEADERS[4]), F.array_join(F.transform("rows", lambda x: x["line"]), "\n"))
    return rows.select(F.concat(F.lit("in/checking/s"), "number", F.lit(".csv")).alias("path"), F.encode(whole, "UTF-8").alias("content"))


QUERIES["import_spanning"] = lambda spark, sf_dir: plain(ingest.parse(spanning_files(spark, sf_dir)).select("path", "row_number", F.col("txn_date").cast("string").alias("txn_date"), "amount", F.regexp_replace("description", r"\s+", " ").alias("description")))
ORACLE_SQL["import_spanning"] = """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 250 AS number, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey AS c FROM orders),
n AS (SELECT *, 2 + coalesce(sum(CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END) OVER (PARTITION BY number ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line FROM o)
SELECT 'in/checking/s' || number || '.csv' AS path, CAST(first_line AS INT) AS row_number, CAST(day AS VARCHAR) AS txn_date, CAST(price AS DOUBLE) AS amount,
 CASE WHEN k % 2 = 0 THEN 'order, ' || k || ' said "yes" to ' || c ELSE 'plain' END || CASE WHEN k % 3 = 0 THEN ' ' || array_to_string(['m' || i FOR i IN range(1, k % 60 + 2)], ' ') ELSE '' END AS description FROM n"""


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three currencies, two of which have a rate every fifth day."""
    o = table(spark, sf_dir, "orders")
    currency = F.element_at(F.array(F.lit("EUR"), F.lit("USD"), F.lit("GBP")), (F.col("o_custkey") % 3 + 1).cast("int"))
    none = {c: F.lit(None).cast("string") for c in ("source_currency", "target_currency")} | {c: F.lit(None).cast("decimal(18,2)") for c in ("source_amount", "target_amount")}
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("txn_date"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), currency.alias("currency")).withColumns(none)
    day = F.col("o_orderdate").cast("date")
    days = o.select(day.alias("rate_date")).distinct().where("pmod(datediff(rate_date, date '1970-01-01'), 5) = 0 and rate_date > date '1992-03-01'")
    rates = days.crossJoin(F.broadcast(spark.createDataFrame([("USD", 0.5), ("GBP", 2.0)], "currency string, base double"))).select("rate_date", "currency", (F.col("base") + F.dayofmonth("rate_date") / 64.0 + 0.0031731).alias("eur_per_unit"))
    return ingest.in_euros(rows, rates)


QUERIES["import_rates"] = lambda spark, sf_dir: plain(converted(spark, sf_dir).select("id", "currency", "stored"))
ORACLE_SQL["import_rates"] = """WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, ['EUR', 'USD', 'GBP'][o_custkey % 3 + 1] AS currency FROM orders),
r AS (SELECT DISTINCT d AS rate_date, c.currency, c.base + day(d) / 64.0::DOUBLE + 0.0031731::DOUBLE AS rate FROM o, (VALUES ('USD', 0.5::DOUBLE), ('GBP', 2.0::DOUBLE)) c(currency, base) WHERE date_diff('day', DATE '1970-01-01', d) % 5 = 0 AND d > DATE '1992-03-01')
SELECT o.id, o.currency, CASE WHEN o.currency = 'EUR' THEN CAST(amount AS DOUBLE) ELSE CAST(CAST(CAST(amount AS DOUBLE) * rate AS DECIMAL(18,2)) AS DOUBLE) END AS stored
FROM o ASOF LEFT JOIN r ON o.currency = r.currency AND o.d >= r.rate_date"""


def in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions of two batches, the first exports and all others; before each a try was broken off, and each is offered twice."""
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    files = cut(export_files(spark, sf_dir))
    for part in (files.where("path like 'in/checking/%'"), files.where("path not like 'in/checking/%'")):
        name = batches.batch_name(part)
        made = ingest.import_files(part, *[batches.read(spark, folder, t) for t in ("files", "accounts", "transactions")])
        made = replace(made, transactions=cut(made.transactions))  # read twice
        made.transactions.limit(5).write.parquet(f"{folder}/transactions/batch={name}")  # as a writer that was lost leaves it
        batches.commit(made, folder, name)
        batches.commit(made, folder, name)
    return batches.read(spark, folder, "transactions")


QUERIES["import_batches"] = lambda spark, sf_dir: plain(in_batches(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("n_duplicates"), F.sum("amount").cast("decimal(18,2)").alias("total")))
ORACLE_SQL["import_batches"] = _ROWS + "SELECT path, count(*) AS n, count(*) FILTER (is_duplicate) AS n_duplicates, CAST(sum(CASE WHEN inward THEN price ELSE -price END) AS DOUBLE) AS total FROM u GROUP BY path"
