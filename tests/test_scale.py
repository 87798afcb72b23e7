"""Steps whose work must follow the rows, not pairs of rows: hot groups of known outcome, and small random ledgers against plain Python."""

from __future__ import annotations

import datetime as dt
import random
import time
from decimal import Decimal

from pyspark.sql import functions as F

from ledgermill.functions import ranges
from ledgermill.operators import cascade, detect, matching, reviews, rules

DAY = dt.date(2026, 1, 1)


def test_blocks_of_a_range_hold_each_number_once(spark):
    rng = random.Random(5)
    pairs = [(a, a + rng.choice([0, 3, 15, 16, 300, 5000])) for a in (rng.randint(1, 70000) for _ in range(40))]
    ask = spark.createDataFrame(pairs, "low long, high long").select("low", "high", F.explode(ranges.blocks_in(F.col("low"), F.col("high"))).alias("at"))
    numbers = spark.range(1, 80000).select("id", F.explode(ranges.blocks_of(F.col("id"))).alias("at"))
    met = ask.join(numbers, "at").groupBy("low", "high").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("a"), F.max("id").alias("b"))
    assert sorted(tuple(r) for r in met.collect()) == sorted((a, b, b - a + 1, b - a + 1, a, b) for a, b in set(pairs))


def refund_texts(spark, rows):
    made = [(i, DAY + dt.timedelta(d), Decimal(str(x)), m, "REFUND" if x > 0 else "") for i, d, x, m in rows]
    frame = spark.createDataFrame(made, "id long, txn_date date, amount decimal(18,2), merchant string, signal_text string")
    return frame.withColumns({"is_duplicate": F.lit(False), "merchant_text": F.coalesce("merchant", F.lit(""))})


def test_refunds_equal_all_pairs(spark):
    rng = random.Random(6)
    names = ["BIKE SHOP", "SHOP 12", "CAFE", "AB", "", None]
    rows = [(i, rng.randint(0, 200), rng.choice([-1, -1, 1]) * rng.choice([rng.randint(1, 3000), rng.randint(1, 90000)]) / 100, rng.choice(names)) for i in range(500)]
    words = lambda m: {w for w in (m or "").split() if len(w) >= 3}
    want = {}
    for i, d, x, m in rows:
        if x > 0:
            near = [(e, j) for j, e, y, n in rows if y < 0 and 0 <= d - e <= 120 and round(abs(-y - x), 2) <= max(10.0, x * 0.2) and (not m or not n or words(m) & words(n))]
            if near:
                want[i] = min(near)[1]
    assert {r["id"]: r["outflow_id"] for r in cascade.refund_rows(refund_texts(spark, rows)).collect()} == want


def test_refunds_of_one_word_and_month_are_no_product(spark):
    n = 60_000
    at = F.col("id") % n
    rows = spark.range(2 * n).select("id", F.date_add(F.lit(DAY), (F.when(F.col("id") < n, 20).otherwise(10) + at % 10).cast("int")).alias("txn_date"), F.when(F.col("id") < n, F.lit(5000)).otherwise(-5000).cast("decimal(18,2)").alias("amount"))
    texts = rows.withColumns({"merchant": F.lit("SHOP"), "merchant_text": F.lit("SHOP"), "signal_text": F.lit("REFUND"), "is_duplicate": F.lit(False)})
    began = time.time()
    assert cascade.refund_rows(texts).agg(F.count("*"), F.min("outflow_id"), F.max("outflow_id")).collect()[0][:] == (n, n, n)
    assert time.time() - began < 120  # by pairs, 3.6 billion


def plain_ledger(spark, rows):
    return spark.createDataFrame([(i, a, DAY + dt.timedelta(d), Decimal(x) / 100) for i, a, d, x in rows], "id long, account_id long, txn_date date, amount decimal(18,2)")


def test_settlements_equal_serial_choice_over_block_borders(spark):
    rng = random.Random(7)
    ids = rng.sample(range(10_000), 900)
    banks, cards = [(i, 0, rng.randint(0, 150), -rng.randint(1, 60)) for i in ids[:500]], [(i, 1, rng.randint(0, 150), rng.randint(1, 60)) for i in ids[500:]]
    want, used = set(), set()
    for i, _, d, x in sorted(banks, key=lambda r: (r[2], r[0])):
        near = sorted((abs(e - d), e, j) for j, _, e, y in cards if j not in used and abs(x + y) <= 1 and abs(e - d) <= 7)
        if near:
            used.add(near[0][2])
            want.add((i, near[0][2], near[0][0]))
    got = matching.settlement_pairs(plain_ledger(spark, banks), plain_ledger(spark, cards))
    assert {tuple(r) for r in got.collect()} == want


def test_settlements_of_one_amount_and_day_are_no_product(spark):
    n = 20_000
    rows = spark.range(2 * n).select("id", (F.col("id") % 2).alias("account_id"), F.lit(DAY).alias("txn_date"), F.when(F.col("id") < n, -5).otherwise(5).cast("decimal(18,2)").alias("amount"))
    began = time.time()
    assert matching.settlement_pairs(rows.where("amount < 0"), rows.where("amount > 0")).agg(F.count("*"), F.countDistinct("card_id"), F.max("gap")).collect()[0][:] == (n, n, 0)
    assert time.time() - began < 120  # by pairs, 400 million in thousands of rounds


def test_transfers_equal_one_by_one_choice(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 2), rng.randint(0, 40), rng.choice([-1, 1]) * rng.randint(1, 4)) for i in rng.sample(range(9000), 400)]
    kinds = {r[0]: rng.randint(0, 2) for r in rows}
    ranks = [[0, 1, None], [1, 0, 1], [None, 1, 0]]
    edges = []
    for i, a, d, x in rows:
        for j, b, e, y in rows:
            if x > 0 and x == -y and a != b and abs(d - e) <= 3 and ranks[kinds[i]][kinds[j]] is not None:
                edges.append((abs(d - e), ranks[kinds[i]][kinds[j]], -x, min(i, j), max(i, j)))
    want, used = set(), set()
    for gap, rank, _, i, j in sorted(edges):
        if not {i, j} & used:
            used |= {i, j}
            want.add((i, j, gap, rank))
    kind = F.element_at(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv]), F.col("id").cast("int"))
    got = matching.equal_amount_pairs(plain_ledger(spark, rows).withColumn("kind", kind), ranks, 3)
    assert {tuple(r)[:4] for r in got.collect()} == want


def test_transfers_of_one_amount_and_day_are_no_product(spark):
    n = 20_000
    rows = spark.range(2 * n).select("id", (F.col("id") % 2).alias("account_id"), F.lit(DAY).alias("txn_date"), F.when(F.col("id") < n, -5).otherwise(5).cast("decimal(18,2)").alias("amount"))
    began = time.time()
    assert matching.transfer_pairs(rows).agg(F.count("*"), F.countDistinct("left_id")).collect()[0][:] == (n, n)
    assert time.time() - began < 120


def test_candidates_of_many_days_do_not_multiply_rows(spark):
    """A row is joined under two spans at most, whatever the number of days."""
    rows = plain_ledger(spark, [(1, 1, 0, 500), (2, 2, 390, -500), (3, 2, 401, -500), (4, 3, -400, -500)])
    assert {(r["left_id"], r["right_id"], r["days"]) for r in matching.transfer_candidates(rows, 400).collect()} == {(1, 2, 390), (1, 4, 400)}
    wide = spark.range(200_000).select("id", "id", F.col("id").alias("account_id"), F.lit(DAY).alias("txn_date"), (F.col("id") + 1).cast("decimal(18,2)").alias("amount")).drop("id").withColumn("id", F.col("account_id"))
    began = time.time()
    assert matching.transfer_candidates(wide, 100_000).isEmpty()
    assert time.time() - began < 120  # by days, 40 billion rows


def test_best_inflows_equal_all_pairs(spark):
    rng = random.Random(9)
    rows = [(i, 1, rng.randint(0, 300), rng.choice([-1, 1]) * rng.choice([rng.randint(1, 400), rng.randint(1, 20000)])) for i in range(600)]
    want = {}
    for i, _, d, x in rows:
        near = [(abs(y + x), e, j) for j, _, e, y in rows if x < 0 < y and 0 <= e - d <= 60 and abs(y + x) <= max(100, -x * 0.02) and j % 5]
        if near:
            want[i] = min(near)[2]
    l = plain_ledger(spark, rows).withColumn("is_duplicate", F.lit(False))
    notes = l.select("id", F.when(F.col("id") % 5 == 0, "internal_transfer").when(F.col("id") % 5 == 1, F.lit(None)).otherwise("income").alias("economic_class"))
    assert {r["to_id"]: r["from_id"] for r in reviews.best_inflows(l, l.select("id"), notes).collect()} == want


def test_rules_that_ask_for_the_same_count_once(spark):
    said = "'x' as economic_class", "cast(rule_id as string) as category", "0.9D as confidence"
    made = spark.range(3000).selectExpr("id + 1 as rule_id", "20 as priority", "'NL1' as direct_debit_id", "cast(id % 300 as double) + 10 as abs_amount", "0.5D as amount_tolerance").selectExpr("*", *said)
    kept = rules.distinct_rules(rules.scoped(made))
    assert kept.agg(F.count("*"), F.max("said.rule_id")).collect()[0][:] == (300, 300)
    texts = spark.createDataFrame([(i, 1, "checking", Decimal(x) / 100, DAY, None, "NL1", "", "") for i, x in enumerate((1000, -1050, 1051, 1049, 30900, 30951, 950, 949))], "id long, account_id long, account_role string, amount decimal(18,2), txn_date date, counterparty_account_hash string, creditor_id string, merchant_text string, signal_text string")
    assert {r["id"]: r["rule_id"] for r in rules.apply_rules(texts, made).collect()} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 300, 6: 1}


def test_regular_debits_count_days_and_rows(spark):
    """Gaps are between rows, so further rows of a day have none; a gap of no days may be asked for."""
    rows = plain_ledger(spark, [(i, 1, d, -1000) for i, d in enumerate([0, 30, 60, 60, 90, 120, 150, 150])])
    first = detect.recurring_debits(rows, ["account_id"], occurrences=6).collect()
    assert [(r["n"], r["n_regular"], r["mad"]) for r in first] == []  # five gaps in range of eight rows
    assert [(r["n"], r["n_regular"]) for r in detect.recurring_debits(rows, ["account_id"], gap=(0, 45)).collect()] == [(8, 7)]
    plan = detect.recurring_debits(rows, ["account_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" not in "".join(x for x in plan.splitlines() if "Window" in x).replace("account_id#", "")
