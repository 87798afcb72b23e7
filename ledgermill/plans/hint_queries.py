"""Queries of hints from places' tags, over results made from the customers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..operators import hints
from ..sources.tables import LEDGER_ORDERS_SQL, ledger_orders, table
from .ledger_queries import plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Search results, by the customer's key modulo the number of these.
RESULTS = (
    '[]', 'no list', '[{"class": "shop", "type": "bakery", "name": "Bread", "osm_type": "node", "osm_id": 17}]', '[{"class": "place", "type": "house"}, {"category": "amenity", "type": "Bar", "display_name": "Bar, Town"}]',
    '[{"class": "office", "type": "bank", "extratags": {"shop": "mall"}}]', '[{"class": "building", "type": "yes", "extratags": {"opening_hours": "24/7", "craft": "brewery"}, "address": {"shop": "shoes"}}]',
    '[{"class": "amenity", "type": "vending_machine", "name": "Machine"}]', '[{"addresstype": "amenity", "type": "clinic"}, {"class": "shop", "type": "mall"}]', '[{"address": {"road": "A"}, "namedetails": {"tourism": "HOTEL"}, "name": "H"}]',
)
_SAYS = (
    None, None, ("Groceries", "", 0.84, "Bread", "OSM shop=bakery", "https://www.openstreetmap.org/node/17"), ("Eating Out", "", 0.84, "Bar, Town", "OSM amenity=bar", "https://www.openstreetmap.org/"), ("Banking and Fees", "", 0.70, "", "OSM office=bank", "https://www.openstreetmap.org/"),
    ("Other", "Local Service", 0.68, "", "OSM craft=brewery", "https://www.openstreetmap.org/"), ("Other", "Local Merchant", 0.62, "Machine", "OSM amenity=vending_machine", "https://www.openstreetmap.org/"), ("Health", "", 0.86, "", "OSM amenity=clinic", "https://www.openstreetmap.org/"),
    ("Holiday", "", 0.84, "H", "OSM tourism=hotel", "https://www.openstreetmap.org/"),
)
_VALUES = ", ".join(f"({i}, '{a}', '{b}', {c}::DOUBLE, '{d}', '{e}', '{f}')" for i, x in enumerate(_SAYS) if x for a, b, c, d, e, f in [x])


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    results = F.element_at(F.array(*[F.lit(x) for x in RESULTS]), (F.col("c_custkey") % len(RESULTS) + 1).cast("int"))
    return hints.place_hints(c.where("c_custkey % 2 = 0").select(hints.lookup_key(F.col("c_name")).alias("lookup_key"), results.alias("results")))


QUERIES["place_hints"] = lambda spark, sf_dir: plain(_cache(spark, sf_dir))
_HINTS = f"v(i, category, subcategory, confidence, label, description, source_url) AS (VALUES {_VALUES}), h AS (SELECT upper(c_name) AS lookup_key, 'household_spend' AS economic_class, v.* EXCLUDE (i) FROM customer JOIN v ON v.i = c_custkey % {len(RESULTS)} WHERE c_custkey % 2 = 0)"
ORACLE_SQL["place_hints"] = f"WITH {_HINTS} SELECT * FROM h"
QUERIES["entity_hints"] = lambda spark, sf_dir: plain(hints.hints_of(ledger_orders(spark, sf_dir), cut(_cache(spark, sf_dir))))
ORACLE_SQL["entity_hints"] = f"WITH {LEDGER_ORDERS_SQL}, {_HINTS} SELECT l.id, h.economic_class, h.category, h.subcategory, h.confidence FROM ledger l JOIN h ON h.lookup_key = upper(l.merchant)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as merchants whose names are words, some of them no names to look up."""
    name = F.concat(F.element_at(F.array(F.lit("Baker "), F.lit("apple pay "), F.lit("Shop nr "), F.lit("Café Ünit ")), (F.col("account_id") % 4 + 1).cast("int")), F.col("account_id"))
    l = ledger_orders(spark, sf_dir).withColumn("merchant", F.upper(name))
    known = l.where("account_id % 5 = 0").select(F.col("merchant").alias("lookup_key"))
    return plain(hints.candidates(l, l.select("id", "economic_class", "category", "confidence"), known).select("merchant", "materiality", "n"))


QUERIES["lookup_candidates"] = _candidates
ORACLE_SQL["lookup_candidates"] = f"""WITH {LEDGER_ORDERS_SQL}, m AS (SELECT upper(['Baker ', 'apple pay ', 'Shop nr ', 'Café Ünit '][account_id % 4 + 1] || account_id) AS merchant, account_id, abs(amount) AS size, confidence FROM ledger WHERE NOT is_duplicate),
g AS (SELECT merchant, CAST(sum(size) AS DOUBLE) AS materiality, count(*) AS n, any_value(account_id) AS c FROM m WHERE confidence < 0.7 AND account_id % 5 <> 0 GROUP BY merchant ORDER BY materiality DESC, n DESC, merchant LIMIT 50)
SELECT merchant, materiality, n FROM g WHERE c % 4 IN (0, 3) AND c < 1000"""
