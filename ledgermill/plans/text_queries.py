"""Queries of the text functions over parts, documents and orders, duplicate flags, and the streaming roll-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detect
from ..sources.tables import table
from .ledger_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(make: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: plain(make(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return make

    return add


def _rewritten() -> str:
    out = "upper(coalesce(raw, ''))"
    for pattern, put in text.MERCHANT_REWRITES:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put}', 'g')"
    return f"left(trim({out}), {text.MERCHANT_LENGTH})"


@query("merchant_normalise", f"WITH r AS (SELECT p_partkey, concat('PayPal *', p_name, ' #', p_partkey, ' ref 20240101 ', p_size, ':30') AS raw FROM part) SELECT p_partkey, {_rewritten()} AS merchant FROM r")
def merchant_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("PayPal *"), F.col("p_name"), F.lit(" #"), F.col("p_partkey"), F.lit(" ref 20240101 "), F.col("p_size"), F.lit(":30"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_merchant(raw).alias("merchant"))


_PART_WORDS = (("Steel", ("STEEL",)), ("Brass", ("BRASS", "COPPER")), ("Small", ("SMALL",)))
_CASES = " ".join(f"WHEN {' OR '.join(f'''contains(upper(p_type), '{w}')''' for w in words)} THEN '{name}'" for name, words in _PART_WORDS)


@query("merchant_categorise", f"SELECT p_partkey, CASE {_CASES} END AS category FROM part")
def merchant_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.categorize(F.col("p_type"), _PART_WORDS).alias("category"))


@query("short_word_match", "SELECT p_partkey, regexp_matches(upper(p_type), '(^|[^A-Z0-9])TIN([^A-Z0-9]|$)') AS has_tin, contains(upper(p_type), 'STEE') AS has_steel FROM part")
def short_word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.contains_word(F.col("p_type"), "tin").alias("has_tin"), text.contains_word(F.col("p_type"), "stee").alias("has_steel"))


@query("parse_amounts", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DOUBLE) AS amount FROM orders")
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in four styles and read again."""
    value = F.col("o_totalprice").cast("decimal(18,2)")
    english = F.format_number(value, 2)
    dutch = F.translate(english, ",.", ".,")
    plain_comma = F.replace(value.cast("string"), F.lit("."), F.lit(","))
    written = F.element_at(F.array(english, dutch, plain_comma, F.concat(F.lit("€ "), value.cast("string"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    flag = F.when(F.col("o_orderkey") % 2 == 0, "Af").otherwise("Bij")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_amount(written, flag).alias("amount"))


@query("parse_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five styles and read again."""
    styles = F.array(*[F.date_format("o_orderdate", p) for p in ("yyyy-MM-dd HH:mm", "d-M-yyyy", "dd/MM/yyyy", "yyyyMMdd", "d.M.yyyy")])
    written = F.element_at(styles, (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_date(written).alias("day"))


@query(
    "extract_ibans",
    """SELECT c_custkey, 'NL' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || 'BANK' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS ibans FROM customer""",
)
def extract_ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account number of the right length among a repeat of it, one too short, and one of the reader's own."""
    iban = F.concat(F.lit("NL"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("BANK"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    memo = F.concat_ws(" ", F.lit("from"), iban, F.lit("via NL00BANK123 and"), iban, F.lit("to DE00123456789012345678."))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(text.extract_ibans(memo, F.lit("DE00123456789012345678")), ",").alias("ibans"))


@query(
    "duplicate_flags",
    """WITH r AS (SELECT event_id, user_id % 3 AS file_seq, sha256(concat_ws('|', upper(trim(event_type)), CAST(CAST(round(value) AS BIGINT) AS VARCHAR))) AS fingerprint FROM events)
SELECT event_id, CAST(file_seq AS BIGINT) AS file_seq, fingerprint, file_seq > min(file_seq) OVER (PARTITION BY fingerprint) AS is_duplicate FROM r""",
)
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("file_seq"), text.fingerprint(F.col("event_type"), F.round("value").cast("long")).alias("fingerprint"))
    return detect.duplicate_flags(rows).select("event_id", "file_seq", "fingerprint", "is_duplicate")


@query(
    "keyed_merge",
    """WITH o AS (SELECT o_orderkey AS id, 'old' AS note FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS id, 'new' AS note FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""",
)
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return detect.merge_keyed(ids.where("id % 2 = 0").withColumn("note", F.lit("old")), ids.where("id % 3 = 0").withColumn("note", F.lit("new")), ["id"])
