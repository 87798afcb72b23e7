"""What places' tags say of merchants: search results as nested maps become hints, which rows look up by a normalised name.

Results come as JSON (lookup_key, results): a list of places, each with its class and type and maps of tags. A hint is what the first rule says that fits the first tag of the first place
that fits any; places, tags and rules are numbered, so the least number decides, by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = "array<struct<category:string,class:string,addresstype:string,type:string,name:string,display_name:string,osm_type:string,osm_id:string,extratags:map<string,string>,address:map<string,string>,namedetails:map<string,string>>>"
#: tags' keys, their values (* for any), and what they say: class, category, subcategory, confidence.
TAG_RULES = (
    (("amenity", "healthcare"), ("dentist", "clinic", "doctors", "hospital", "pharmacy", "physiotherapist", "orthodontist"), "household_spend", "Health", "", 0.86),
    (("amenity",), ("restaurant", "cafe", "bar", "pub", "fast_food", "ice_cream", "food_court"), "household_spend", "Eating Out", "", 0.84),
    (("shop",), ("supermarket", "convenience", "greengrocer", "bakery", "butcher", "deli", "cheese", "seafood"), "household_spend", "Groceries", "", 0.84),
    (("tourism", "aeroway"), ("hotel", "hostel", "apartment", "guest_house", "camp_site", "travel_agency", "terminal"), "household_spend", "Holiday", "", 0.84),
    (("amenity", "railway", "public_transport"), ("fuel", "parking", "taxi", "bicycle_rental", "station", "tram_stop", "bus_station", "platform"), "household_spend", "Transportation", "", 0.80),
    (("shop",), ("clothes", "shoes", "department_store", "furniture", "electronics", "doityourself", "hardware", "books", "gift", "sports", "mall"), "household_spend", "Shopping", "", 0.80),
    (("office", "amenity"), ("insurance", "bank", "financial_advice"), "household_spend", "Banking and Fees", "", 0.70),
    (("office", "amenity"), ("government", "townhall", "courthouse", "post_office"), "household_spend", "Taxes and Government", "", 0.74),
    (("craft",), ("*",), "household_spend", "Other", "Local Service", 0.68),
    (("shop", "amenity"), ("*",), "household_spend", "Other", "Local Merchant", 0.62),
)
#: Names that no look-up can tell apart, and parts of names that aren't a merchant's.
GENERIC_NAMES = ("", "SEPA", "SEPA OVERBOEKING", "TRANSFER", "TRANSACTION", "OVERSCHRIJVING", "INCASSO", "BETALING", "ONLINE BETALING", "CARD", "MASTERCARD", "VISA")
UNSAFE = (r"\bAPPLE PAY\b", r"\bGOOGLE PAY\b", r"\bPAY\.NL\b", r"\bPAS[A-Z0-9]*\b", r"\bNR\b", r"\bBEA\b", r"\bVALUE DATE\b", r"\bTRANSACTION\b", r"\bSEPA\b", r"\bIBAN\b", r"\bBIC\b", r"\b\d{1,2}[.:]\d{2}\b")
ACCOUNT = r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"


def lookup_key(merchant: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(merchant, F.lit(""))), r"\s+", " "))


def is_lookup_safe(merchant: Column) -> Column:
    """Whether a name may be sent to a look-up: it names a merchant, and holds no account, card or terminal number."""
    key = lookup_key(merchant)
    lacks = lambda pattern: ~F.regexp_like(key, F.lit(pattern))
    out = ~key.isin(*GENERIC_NAMES) & F.length(key).between(4, 80) & F.regexp_like(key, F.lit("[A-Z]{3}")) & (F.length(F.regexp_replace(key, r"\D", "")) < 4)
    for pattern in (ACCOUNT, *UNSAFE):
        out = out & lacks(pattern)
    return out


def tag_pairs(place: Column) -> Column:
    """(key, value) of a place, in lower case: its class with its type, under each name that has one, then the tags of its maps."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    pair = lambda k, v: F.struct(low(k).alias("key"), low(v).alias("value"))
    own = F.filter(F.array(*[pair(place[c], place["type"]) for c in ("category", "class", "addresstype")]), lambda p: (p["key"] != "") & (p["value"] != ""))
    tags = lambda c: F.transform(F.filter(F.coalesce(F.map_entries(place[c]), F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].isNotNull()), lambda e: pair(e["key"], e["value"]))
    return F.concat(own, tags("extratags"), tags("address"), tags("namedetails"))


def place_hints(found: DataFrame) -> DataFrame:
    """(lookup_key, economic_class, category, subcategory, confidence, label, description, source_url): a hint for each key whose results have a tag that a rule knows.

    found has lookup_key and results, JSON as text; results that aren't a list of places give none.
    """
    spark = found.sparkSession
    flat = [(n, key, value, *said) for n, (keys, values, *said) in enumerate(TAG_RULES) for key in keys for value in values]
    said = F.broadcast(spark.createDataFrame(flat, "rule int, rule_key string, rule_value string, economic_class string, category string, subcategory string, confidence double"))  # some 70 rows
    places = found.select("lookup_key", F.posexplode(F.from_json("results", PLACES)).alias("place", "p"))
    pairs = places.select("lookup_key", "place", "p", F.posexplode(tag_pairs(F.col("p"))).alias("pair", "t"))
    met = pairs.join(said, F.col("t.key") == F.col("rule_key")).where((F.col("rule_value") == "*") | (F.col("rule_value") == F.col("t.value")))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    where = F.when((text("p.osm_type") != "") & (text("p.osm_id") != ""), F.concat(F.lit("https://www.openstreetmap.org/"), text("p.osm_type"), F.lit("/"), text("p.osm_id"))).otherwise("https://www.openstreetmap.org/")
    label = F.coalesce(F.nullif("p.name", F.lit("")), "p.display_name", F.lit(""))
    fields = {"label": label, "description": F.concat(F.lit("OSM "), "t.key", F.lit("="), "t.value"), "source_url": where}
    names = ["economic_class", "category", "subcategory", "confidence"]
    best = met.groupBy("lookup_key").agg(F.min(F.struct("place", "pair", "rule", *names, *[v.alias(n) for n, v in fields.items()])).alias("h"))
    return best.select("lookup_key", *[f"h.{n}" for n in [*names, *fields]])


def candidates(ledger: DataFrame, annotations: DataFrame, cache: DataFrame, top: int = 50) -> DataFrame:
    """(merchant, materiality, n): the merchants that most of what is uncertain went to and that the cache doesn't know; of these top ones, those whose name may be looked up."""
    uncertain = (F.col("economic_class") == "needs_review") | ((F.col("category") == "Uncategorized") & (F.abs("amount") >= 50)) | (F.col("category") == "Other") | (F.col("confidence") < 0.70)
    rows = ledger.where("not is_duplicate and merchant <> ''").select("id", "merchant", "amount").join(annotations.select("id", "economic_class", "category", "confidence"), "id").where(uncertain)
    sums = rows.groupBy("merchant").agg(F.sum(F.abs("amount")).cast("decimal(28,2)").alias("materiality"), F.count("*").alias("n"))
    unknown = sums.join(cache.select(F.col("lookup_key").alias("merchant")).distinct(), "merchant", "left_anti")
    return unknown.orderBy(F.desc("materiality"), F.desc("n"), "merchant").limit(top).where(is_lookup_safe(F.col("merchant")))


def hints_of(ledger: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, economic_class, category, subcategory, confidence): the hint of each row's merchant, by its normalised name; the distinct names are joined, then the rows."""
    known = cache.where("category <> ''").select("lookup_key", F.coalesce("economic_class", F.lit("household_spend")).alias("economic_class"), "category", F.coalesce("subcategory", F.lit("")).alias("subcategory"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    names = ledger.select("merchant").where("merchant is not null").distinct().withColumn("lookup_key", lookup_key(F.col("merchant"))).join(known, "lookup_key").drop("lookup_key")
    return ledger.select("id", "merchant").join(names, "merchant").drop("merchant")
