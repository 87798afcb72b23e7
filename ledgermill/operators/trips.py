"""Holiday trips: islands of days of spending in a foreign country, grown from seeds, which then absorb what was spent by card around them.

Seeds are counted by country and day before anything is ordered, so the islands are found over a calendar of days, however many rows there are. The padded days of trips
are a table of (day, country) too; rows join it by their day, and by their country where they name one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as k
from ..functions.joins import MOST_BROADCAST
from ..functions.storage import cut
from .cascade import has

#: Country codes of card terminals and names of countries, with what they are called.
CODES = {
    "ESP": "Spain", "ITA": "Italy", "FRA": "France", "GRC": "Greece", "PRT": "Portugal", "HRV": "Croatia", "TUR": "Turkey", "GBR": "United Kingdom", "AUT": "Austria", "CHE": "Switzerland", "USA": "United States", "MAR": "Morocco", "MEX": "Mexico", "THA": "Thailand",
    "IDN": "Indonesia", "EGY": "Egypt", "CYP": "Cyprus", "MLT": "Malta",
}
NAMES = {
    "SPAIN": "Spain", "ITALY": "Italy", "FRANCE": "France", "GREECE": "Greece", "PORTUGAL": "Portugal", "CROATIA": "Croatia", "TURKEY": "Turkey", "AUSTRIA": "Austria", "SWITZERLAND": "Switzerland", "MOROCCO": "Morocco", "CYPRUS": "Cyprus", "MALTA": "Malta",
    "EGYPT": "Egypt", "THAILAND": "Thailand", "INDONESIA": "Indonesia",
}
#: What tells a row at home, one bought online, and one paid at a terminal.
HOME = ("NLD", "NEDERLAND")
HOME_CITIES = (
    "AMSTERDAM", "AMSTELVEEN", "UITHOORN", "AALSMEER", "ZAANDAM", "HAARLEM", "HOOFDDORP", "SCHIPHOL", "DIEMEN", "DUIVENDRECHT", "BADHOEVEDORP", "OUDERKERK", "ABCOUDE", "MIJDRECHT", "UTRECHT", "ROTTERDAM", "DEN HAAG", "EINDHOVEN", "GRONINGEN", "ARNHEM", "NIJMEGEN", "TILBURG",
    "BREDA", "ALMERE", "ZWOLLE", "LEIDEN", "DELFT", "PURMEREND", "HILVERSUM", "ALKMAAR", "ZEIST", "AMERSFOORT", "APELDOORN", "ENSCHEDE", "MAASTRICHT", "LELYSTAD", "HAARLEMMERMEER", "VOLENDAM", "LISSE", "HEEMSTEDE", "BUSSUM", "WEESP",
)
ONLINE = ("AMAZON", "AMZN", "PAYPAL", "BOL.COM", "IDEAL", "UBER", "NETFLIX", "SPOTIFY", "HELP.", "AMAZON.NL", "AMAZON.DE", "MARKTPLAATS", "COOLBLUE", "ZALANDO")
TERMINAL = ("PAYMENT TERMINAL", "KAARTNUMMER", "CARD SEQUENCE", "TRANSACTIEDATUM")
MONTHS, LEAST_SEEDS, MOST_GAP, PAD = (6, 7, 8, 9), 3, 5, 3
#: Families of words of rows that are no spending abroad.
NOT_ABROAD = ("bank_transfer", "savings", "mortgage", "investment", "card")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def country(text: Column) -> Column:
    """The country that a row names: by a terminal's code, else by name, the first in the tables' order; null if none."""
    whole = lambda word: F.regexp_like(text, F.lit(rf"\b{word}\b"))
    out = F.lit(None).cast("string")
    for name, said in reversed(NAMES.items()):
        out = F.when(whole(name), said).otherwise(out)
    coded = out
    for code, said in reversed(CODES.items()):
        coded = F.when(whole(code), said).otherwise(coded)
    return F.when(F.contains(text, F.lit(TERMINAL[0])), coded).otherwise(out)


def seen(texts: DataFrame, families: k.Families = k.FAMILIES) -> DataFrame:
    """(id, txn_date, country, absorbable) of the outflows of a ledger with texts: absorbable ones were paid at a terminal and may belong to a trip that they don't name."""
    content = F.upper(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("counterparty_name", "description", "merchant", "reference")]))
    raw = F.col("raw_text")
    home = _any(raw, HOME) | F.regexp_like(raw, F.lit(r"\b(" + "|".join(HOME_CITIES) + r")\b"))
    other = F.lit(False)
    for family in NOT_ABROAD:
        other = other | has(family, families, "content")
    rows = texts.where("not is_duplicate and amount < 0").withColumn("content", content)
    abroad = _any(raw, TERMINAL) & ~home & ~_any(raw, ONLINE) & ~has("cash_out", families, "raw_text") & ~other & ~F.regexp_like("content", F.lit(k.CREDITOR_ID))
    return rows.select("id", "txn_date", country(raw).alias("country"), abroad.alias("absorbable"))


def trips(rows: DataFrame, months: tuple[int, ...] = MONTHS, gap: int = MOST_GAP, least: int = LEAST_SEEDS) -> DataFrame:
    """(country, first_day, last_day, n): runs of seeds of a country, in holiday months, with no gap of more than so many days."""
    days = rows.where(F.col("country").isNotNull() & F.month("txn_date").isin(*months)).groupBy("country", F.col("txn_date").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("country").orderBy("day")
    begins = F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap).cast("int"), F.lit(1))
    runs = days.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w))
    return runs.groupBy("country", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n")).where(F.col("n") >= least).drop("run")


def absorbed(rows: DataFrame, found: DataFrame, pad: int = PAD) -> DataFrame:
    """(id, label): each row with the first trip, by country and day, that holds its day: one of its own country, or any if it is absorbable."""
    days = cut(found.select("country", "first_day", F.explode(F.sequence(F.date_sub("first_day", pad), F.date_add("last_day", pad))).alias("txn_date")))
    own = days.groupBy("country", "txn_date").agg(F.min("first_day").alias("own_first"))
    any_ = days.groupBy("txn_date").agg(F.min(F.struct("country", "first_day")).alias("any_trip"))
    few = days.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    side = lambda frame: F.broadcast(frame) if few else frame
    met = rows.join(side(any_), "txn_date").join(side(own), ["country", "txn_date"], "left")
    mine = F.when(F.col("own_first").isNotNull(), F.struct("country", F.col("own_first").alias("first_day")))
    trip = F.when(F.col("absorbable"), F.col("any_trip")).otherwise(mine)
    return met.withColumn("trip", trip).where("trip is not null").select("id", F.concat_ws(" ", "trip.country", F.year("trip.first_day")).alias("label"))


def holiday_rows(texts: DataFrame, families: k.Families = k.FAMILIES) -> DataFrame:
    """(id, label) of every row of a holiday trip."""
    rows = cut(seen(texts, families))
    return absorbed(rows, trips(rows))
