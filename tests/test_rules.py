"""Rules, the review loop, medians and trips in odd cases."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgermill.functions import joins
from ledgermill.operators import detect, hints, reviews, rules, trips

TEXTS = "id long, account_id long, account_role string, amount int, txn_date date, counterparty_account_hash string, creditor_id string, merchant_text string, signal_text string"


def rule_frame(spark, *made):
    kinds = rules.RULES
    rows = [{"priority": 1, "economic_class": "c", "category": f"r{r['rule_id']}", "confidence": 0.9, **r} for r in made]
    return spark.createDataFrame([[r.get(c) for c in kinds] for r in rows], ", ".join(f"{c} {t}" for c, t in kinds.items()))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        [
            (1, 1, "checking", -10, date(2024, 3, 1), None, None, "BAKER STREET", "BREAD AT BAKER STREET"), (2, 1, None, 5, date(2024, 4, 1), "h", None, "", ""), (3, 2, "savings", -100, None, "h", "NL00ZZZ1", None, None),
            (4, 2, "checking", None, date(2024, 4, 1), None, "NL00ZZZ1", "BAKER", "SHORT"), (5, 3, "checking", -103, date(2024, 3, 9), "", "NL00ZZZ1", "ÉCLAIR ÉÉÉÉ", "X"),
        ],
        TEXTS,
    ).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def decided(frame):
    return {r["id"]: r["category"] for r in frame.collect()}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_conditions_and_scopes(spark, texts, monkeypatch, few):
    monkeypatch.setattr(rules, "MOST_BROADCAST", few)
    made = rule_frame(
        spark, {"rule_id": 1, "merchant_contains": " baker  street "}, {"rule_id": 2, "counterparty_account_hash": "h", "direction": "inflow"}, {"rule_id": 3, "direct_debit_id": "nl00zzz1", "abs_amount": 100.0, "amount_tolerance_pct": 0.03},
        {"rule_id": 4, "merchant_contains": "éclair", "priority": 0, "months": [3]}, {"rule_id": 5, "priority": 0, "merchant_contains": "BAK"}, {"rule_id": 6, "priority": 0, "direct_debit_id": "NL00ZZZ1"}, {"rule_id": 7, "priority": 0, "description_contains": "BREAD"},
        {"rule_id": 8, "priority": 2, "account_id": 2}, {"rule_id": 9, "priority": 0, "transaction_id": 1, "min_abs_amount": 11.0},
    )
    assert decided(rules.apply_rules(texts, made)) == {1: "r1", 2: "r2", 3: "r3", 4: "r8", 5: "r4"}


def test_no_rules_or_rows(spark, texts):
    none = rule_frame(spark).limit(0)
    assert decided(rules.apply_rules(texts, none)) == {}
    assert decided(rules.apply_rules(texts.limit(0), rule_frame(spark, {"rule_id": 1, "merchant_contains": "BAKER"}))) == {}


def test_texts_that_hold_patterns(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("AB C") for _ in range(n))
    lines, asked = {word(rng.randint(0, 30)) for _ in range(150)}, {word(rng.randint(4, 9)) for _ in range(80)}
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = {tuple(r) for r in rules.text_matches(frame(lines, "text"), frame(asked, "pattern")).collect()}
    assert got == {(t, p) for t in lines for p in asked if p in t}


def test_hot_keys_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(joins, "FEW_ROWS", 10)
    rows = spark.range(200).select(F.when(F.col("id") < 90, "hot").when(F.col("id") < 100, None).otherwise(F.concat(F.lit("k"), F.col("id") % 60)).alias("key"), "id")
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), (None, 4)], "key string, v int")
    assert sorted(map(tuple, joins.join_spread(rows, side, "key").collect())) == sorted(map(tuple, rows.join(side, "key").collect()))


def test_links_by_hand(spark):
    notes = spark.createDataFrame([(1, "income", "Income", "", 0.9, "auto", "x"), (2, "internal_transfer", "T", "", 0.9, "auto", "x"), (3, "refund", "R", "", 0.9, "auto", "x")], "id long, economic_class string, category string, subcategory string, confidence double, digest_tier string, rule string")
    ledger = spark.createDataFrame([(1, 101, date(2024, 1, 31)), (2, 100, date(2024, 1, 20)), (3, 100, date(2024, 5, 1)), (4, -100, date(2024, 1, 10)), (5, -7, date(2024, 1, 1))], "id long, amount int, txn_date date").withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("is_duplicate", F.lit(False))
    made = reviews.best_inflows(ledger, ledger.select("id"), notes)
    assert [(r["from_id"], r["to_id"], float(r["amount"])) for r in made.collect()] == [(1, 4, 100.0)]
    after = {r["id"]: (r["category"], r["digest_tier"]) for r in reviews.offset_annotations(notes, made).collect()}
    assert after == {1: ("Reimbursements", "reviewed"), 2: ("T", "auto"), 3: ("R", "auto")}


def test_medians_of_many_values(spark):
    rng = random.Random(3)
    rows = [(g, round(rng.choice([rng.gauss(0, 5), rng.expovariate(1e-4), -7.25]), 2)) for g in "abc" for _ in range(rng.choice([1, 2, 501]))] + [("d", 0.0), ("d", -0.01), ("e", None)]
    got = {r["g"]: float(r["median"]) for r in detect.upper_medians(spark.createDataFrame(rows, "g string, v double").withColumn("v", F.col("v").cast("decimal(18,2)")), ["g"], "v").collect()}
    assert got == {g: sorted(v for h, v in rows if h == g)[len([1 for h, _ in rows if h == g]) // 2] for g in "abcd"}


def test_trips_absorb_by_country_first(spark):
    days = [(i, date(2024, 7, 1 + i), "Spain", False) for i in range(3)] + [(10 + i, date(2024, 7, 3 + 2 * i), "Italy", False) for i in range(3)]
    more = [(20, date(2024, 7, 4), None, True), (21, date(2024, 7, 4), None, False), (22, date(2024, 6, 27), None, True), (23, date(2024, 6, 28), None, True), (24, date(2024, 7, 11), "Greece", True), (25, None, "Spain", True)]
    rows = spark.createDataFrame(days + more, "id int, txn_date date, country string, absorbable boolean")
    assert sorted(map(tuple, trips.trips(rows).collect())) == [("Italy", date(2024, 7, 3), date(2024, 7, 7), 3), ("Spain", date(2024, 7, 1), date(2024, 7, 3), 3)]
    got = {r["id"]: r["label"] for r in trips.absorbed(rows, trips.trips(rows)).collect()}
    assert got == {0: "Spain 2024", 1: "Spain 2024", 2: "Spain 2024", 10: "Italy 2024", 11: "Italy 2024", 12: "Italy 2024", 20: "Italy 2024", 23: "Spain 2024"}


def test_hints_from_odd_results(spark):
    made = [("A", '[{"class": "SHOP", "type": null, "extratags": {"shop": "Mall", "craft": null}}]'), ("B", '{"class": "shop", "type": "deli"}'), ("C", None), ("D", "[]"), ("E", '[{"class": "craft", "type": "x"}, {"class": "shop", "type": "deli"}]'), ("F", '[{"extratags": "none", "class": "amenity", "type": "post_office"}]')]
    got = {r["lookup_key"]: (r["category"], r["subcategory"]) for r in hints.place_hints(spark.createDataFrame(made, "lookup_key string, results string")).collect()}
    assert {k: got[k] for k in ("A", "E")} == {"A": ("Shopping", ""), "E": ("Other", "Local Service")}
    assert not {"C", "D"} & set(got)


def test_names_that_may_be_looked_up(spark):
    names = {"Bakker  Jan": True, "visa": False, "ABC": False, "NL91ABNA0417164300 X": False, "SHOP 1234": False, "SHOP 123": True, "BEA SHOP": False, "AT 12:30 CAFE": False, None: False, "A" * 81: False, "12 AB CD": False}
    frame = spark.createDataFrame([(n,) for n in names], "m string").select("m", hints.is_lookup_safe(F.col("m")).alias("safe"))
    assert {r["m"]: r["safe"] for r in frame.collect()} == names
