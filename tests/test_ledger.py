"""Ledger operators on small ledgers of known outcome, and against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermill.engine import Ledger
from ledgermill.functions import text
from ledgermill.operators import analytics, detect, matching, periods, snapshots
from ledgermill.sources import profiles
from ledgermill.streaming import ingest

SCHEMA = "id long, account_id long, txn_date date, amount decimal(18,2), merchant string, category string, subcategory string, economic_class string, confidence double, is_duplicate boolean"


def ledger(spark, rows):
    return spark.createDataFrame([(i, a, dt.date.fromisoformat(d), Decimal(str(x)), m, c, s, e, 0.9, False) for i, a, d, x, m, c, s, e in rows], SCHEMA)


MONTH = [
    (1, 1, "2026-01-25", 5000, "work", "Salary", "Base", "income"),
    (2, 1, "2026-01-03", -100, "shop", "Groceries", "", "household_spend"),
    (3, 1, "2026-01-04", -300, "card", snapshots.UNKNOWN_CARD_CATEGORY, "", "household_spend"),
    (4, 1, "2026-01-05", -180, "grid", "Utilities", "", "household_spend"),
    (5, 1, "2026-01-06", -1500, "bank", "Mortgage", "", "debt_service"),
    (6, 1, "2026-01-07", 20, "shop", "Groceries", "", "refund"),
    (7, 1, "2026-01-08", 120, "work", "Reimbursements", "", "reimbursement_pass_through"),
    (8, 1, "2026-01-09", -1000, "broker", "Investments", "", "wealth_allocation"),
]


def test_month_of_known_outcome(spark):
    row = snapshots.snapshots(ledger(spark, MONTH)).first()
    want = {"real_income": 5000, "gross_outflow": 2080, "reimbursements_cleared": 120, "normalized_burn": 1940, "net_savings": 3060, "wealth_allocation": 1000, "net_cash_change": 2060}
    assert {k: int(row[k]) for k in want} == want
    assert row["savings_rate"] == pytest.approx(3060 / 5000)


def test_reimbursement_a_month_later(spark):
    rows = [(1, 1, "2026-01-05", -1000, "card", snapshots.UNKNOWN_CARD_CATEGORY, "", "household_spend"), (2, 1, "2026-02-05", 600, "work", "", "", "reimbursement_pass_through")]
    months = {r["month"]: r for r in snapshots.snapshots(ledger(spark, rows)).collect()}
    assert (months["2026-01"]["reimbursements_cleared"], months["2026-01"]["cashflow_burn"], months["2026-02"]["net_savings"]) == (600, 400, 0)


def queue(spend, received):
    cleared, used, waiting = [0] * len(spend), [0] * len(spend), []
    for i, (s, r) in enumerate(zip(spend, received)):
        waiting.append([i, s])
        while r > 0 and waiting:
            k = min(r, waiting[0][1])
            cleared[waiting[0][0]] += k
            used[i] += k
            r -= k
            waiting[0][1] -= k
            if waiting[0][1] == 0:
                waiting.pop(0)
    return cleared, used


def test_fifo_windows_equal_the_queue(spark):
    rng = random.Random(1)
    rows, wanted = [], {}
    for e in range(60):
        n = rng.randint(1, 12)
        spend, received = [rng.choice([0, rng.randint(0, 90)]) for _ in range(n)], [rng.choice([0, rng.randint(0, 120)]) for _ in range(n)]
        for i, x in enumerate(zip(spend, received, *queue(spend, received))):
            rows.append((e, f"2026-{i + 1:02}", Decimal(x[0]), Decimal(x[1])))
            wanted[e, f"2026-{i + 1:02}"] = x[2:]
    frame = spark.createDataFrame(rows, "e int, month string, spend decimal(18,2), received decimal(18,2)")
    got = {(r["e"], r["month"]): (int(r["cleared"]), int(r["payback_used"])) for r in snapshots.fifo_clearing(frame, "spend", "received", entity=("e",)).collect()}
    assert got == wanted


def test_linked_reimbursements_and_amortization(spark):
    rows = [*MONTH, (9, 1, "2026-02-09", -1800, "sofa", "Home", "", "household_spend"), (10, 1, "2026-03-01", 300, "friend", "", "", "internal")]
    links = spark.createDataFrame([(9, 10, Decimal(300))], "outflow_id long, inflow_id long, amount decimal(18,2)")
    rules = spark.createDataFrame([(9, Decimal(150), "2026-02", None)], "transaction_id long, monthly_amount decimal(18,2), start_month string, end_month string")
    months = {r["month"]: r for r in snapshots.snapshots(ledger(spark, rows), links, rules).collect()}
    assert (months["2026-02"]["reimbursements_cleared"], months["2026-02"]["cashflow_burn"], months["2026-02"]["normalized_burn"]) == (300, 1500, 0)
    assert months["2027-01"]["normalized_burn"] == 150 and "2027-02" not in months
    assert snapshots.broken_identities(snapshots.snapshots(ledger(spark, rows), links, rules)).isEmpty()


def test_periods(spark):
    months = [f"{y}-{m:02}" for y in (2022, 2023, 2025) for m in (1, 2, 5, 6, 7, 8)]
    frame = spark.createDataFrame([(m,) for m in months], "month string")
    of = lambda p, **k: sorted(r["month"] for r in periods.filter_period(frame, p, **k).collect())
    assert of("all") == months and of("last13") == months[-13:] and of("nonsense") == months[-13:]
    assert of("last2years") == months[6:] and of("year:2023") == months[6:12] == of("2023")
    assert of("years:2022,2025") == months[:6] + months[12:] and of("ytd") == months[12:] and of("ytd", as_of="2023-04") == months[6:12]
    assert tuple(periods.bounds(periods.filter_period(frame, "years:2022,2025")).first()) == ("2022-01", "2025-08")
    assert tuple(periods.bounds(frame.limit(0)).first()) == ("0000-00", "9999-99")
    assert [r["month"] for r in periods.complete_months(frame, "2025-08").orderBy("month").collect()] == months[:-1]


def greedy(edges):
    used, out = set(), []
    for e in sorted(edges):
        if not {e[1], e[2]} & used:
            used |= {e[1], e[2]}
            out.append((e[1], e[2]))
    return sorted(out)


def test_mutually_best_rounds_equal_one_by_one_choice(spark):
    rng = random.Random(3)
    edges = {(rng.randint(0, 40), *sorted(rng.sample(range(40), 2))) for _ in range(150)}
    frame = spark.createDataFrame(list(edges), "days int, left_id long, right_id long")
    got = sorted((r["left_id"], r["right_id"]) for r in matching.both_ends_pairs(frame, ["days"]).collect())
    assert got == greedy(edges)

def test_deferred_acceptance_equals_serial_choice(spark):
    rng = random.Random(4)
    edges = {(rng.randint(0, 25), rng.randint(0, 20)): rng.randint(0, 9) for _ in range(160)}
    frame = spark.createDataFrame([(a, b, w, a % 5) for (a, b), w in edges.items()], "a long, b long, w int, turn int")
    free, wanted = set(range(21)), {}
    for a in sorted({a for a, _ in edges}, key=lambda a: (a % 5, a)):
        if options := [(w, b) for (x, b), w in edges.items() if x == a and b in free]:
            wanted[a] = min(options)[1]
            free.discard(wanted[a])
    got = {r["a"]: r["b"] for r in matching.one_sided_pairs(frame, "a", "b", ["w"], ["turn"]).collect()}
    assert got == wanted
    assert matching.one_sided_pairs(frame.limit(0), "a", "b", ["w"], ["turn"]).isEmpty()


def test_no_transaction_is_in_two_transfers(spark):
    rows = [(3, 1, dt.date(2026, 1, 1), Decimal("50.00")), (5, 2, dt.date(2026, 1, 1), Decimal("-50.00")), (7, 3, dt.date(2026, 1, 1), Decimal("50.00"))]
    pairs = matching.transfer_pairs(spark.createDataFrame(rows, "id long, account_id long, txn_date date, amount decimal(18,2)")).collect()
    assert [(r["left_id"], r["right_id"]) for r in pairs] == [(3, 5)]


def test_spaced_account_numbers_and_debit_words(spark):
    frame = spark.createDataFrame([("to NL91 ABNA 0417 1643 00 TODAY", "5,00", "Uit"), ("GB29 NWBK 6016 1331 9268 19, de89-3704-0044-0532-0130-00", "5,00", "withdrawal"), ("NL91 ABNA 0417 1643 0", "5,00", "bij")], "t string, a string, f string")
    got = frame.select(text.extract_ibans(F.col("t")).alias("x"), text.parse_amount(F.col("a"), F.col("f")).alias("a")).collect()
    assert [r["x"] for r in got] == [["NL91ABNA0417164300"], ["GB29NWBK60161331926819", "DE89370400440532013000"], []]
    assert [r["a"] for r in got] == [Decimal("-5.00"), Decimal("-5.00"), Decimal("5.00")]


def test_two_transfers_on_one_day(spark):
    rows = [(i, 1 + i // 2, "2026-01-05", 50 if i < 2 else -50, "", "", "", "x") for i in range(4)]
    edges = matching.transfer_candidates(ledger(spark, rows)).withColumn("falling", -F.col("amount"))
    pairs = matching.both_ends_pairs(edges, ["days", "falling"]).collect()
    assert edges.count() == 4 and len(pairs) == 2 and len({x for r in pairs for x in (r["left_id"], r["right_id"])}) == 4


def test_trips_and_members(spark):
    days = ["2026-07-01", "2026-07-06", "2026-07-07", "2026-07-13", "2026-07-14"]
    rows = [(i, 1, d, -10, "", "", "", "x") for i, d in enumerate(days)]
    trips = detect.trip_islands(ledger(spark, rows).withColumn("country", F.lit("Norway")), ["country"])
    assert [(str(r["first_day"]), str(r["last_day"]), r["n"]) for r in trips.collect()] == [("2026-07-01", "2026-07-07", 3)]
    members = detect.trip_members(ledger(spark, [*rows, (9, 1, "2026-07-10", -5, "", "", "", "x")]), trips)
    assert {(r["id"], r["label"]) for r in members.collect()} == {(i, "Norway 2026") for i in (0, 1, 2, 9)}


def test_recurring_debits(spark):
    rows = [(i, 1, f"2026-{i + 1:02}-05", -50 - i / 100, "gym", "", "", "x") for i in range(7)] + [(20 + i, 2, f"2026-0{i + 1}-05", -50 - 20 * i, "bar", "", "", "x") for i in range(7)]
    groups = detect.recurring_debits(ledger(spark, rows), ["merchant"]).collect()
    assert [(r["merchant"], r["n"], r["n_regular"]) for r in groups] == [("gym", 7, 6)]


def test_rules_need_a_scope(spark):
    rows = ledger(spark, [(1, 1, "2026-01-01", -10, "Corner Market", "", "", "x"), (2, 2, "2026-01-02", 10, "Corner Market", "", "", "x")])
    rules = spark.createDataFrame([(1, 5, None, None, None, "out", None, None, None, None, "income", "A", 0.9), (2, 9, None, None, "corner", "out", None, None, None, None, "refund", "B", 0.9), (3, 7, None, 2, None, None, None, None, None, None, "income", "C", 0.9)], detect.RULE_SCHEMA)
    assert {r["id"]: r["rule_id"] for r in detect.match_rules(rows, rules).collect()} == {1: 2, 2: 3}
    assert detect.rule_scope("x", None, False) == "counterparty" and detect.rule_scope(None, "ab", False) == "transaction" and detect.rule_scope(None, "abcd", False) == "merchant"


def test_amounts_and_dates(spark):
    cases = {"1.234,56": "1234.56", "1,234.56": "1234.56", "-12,5": "-12.50", "145,45": "145.45", "12.5": "12.50", "€ 7": "7.00", "+1.987,19": "1987.19", "": None, None: None, "abc": None}
    frame = spark.createDataFrame([(k,) for k in cases], "x string")
    got = [r[0] for r in frame.select(text.parse_amount(F.col("x"))).collect()]
    assert [None if v is None else str(v) for v in got] == list(cases.values())
    dates = {"2026-01-31 10:11": "2026-01-31", "1-2-2026": "2026-02-01", "31/12/2025": "2025-12-31", "20260105": "2026-01-05", "no": None, None: None}
    frame = spark.createDataFrame([(k,) for k in dates], "x string")
    assert [r[0] and str(r[0]) for r in frame.select(text.parse_date(F.col("x"))).collect()] == list(dates.values())


def test_exports(spark, tmp_path):
    (tmp_path / "checking.csv").write_text("Datum;Naam / Omschrijving;Rekening;Tegenrekening;Code;Af Bij;Bedrag (EUR);MutatieSoort;Mededelingen\n20260105;Shop;NL01BANK0000000001;;BA;Af;1.010,50;Pin;Pas 12\n;;;;;;;;\n20260125;Work;NL01BANK0000000001;NL02BANK0000000002;OV;Bij;5000,00;Pay;\n")
    rows = profiles.read_export(spark, str(tmp_path / "checking.csv")).collect()
    assert [(r["institution"], str(r["txn_date"]), str(r["amount"]), r["counterparty_account"]) for r in rows] == [("checking", "2026-01-05", "-1010.50", None), ("checking", "2026-01-25", "5000.00", "NL02BANK0000000002")]
    (tmp_path / "tab.tab").write_text("123456789\tEUR\t20260105\t100,00\t54,55\t20260106\t-45,45\tGroceries\n")
    row = profiles.read_export(spark, str(tmp_path / "tab.tab")).first()
    assert (row["institution"], str(row["amount"]), str(row["closing_balance"]), str(row["booking_date"])) == ("booked", "-45.45", "54.55", "2026-01-06")
    (tmp_path / "wallet.csv").write_text('ID,Status,Direction,Finished on,Source fee amount,Source fee currency,Source name,Source amount (after fees),Source currency,Target name,Target amount (after fees),Target currency\nT1,COMPLETED,OUT,2026-01-05 10:00:00,1.5,EUR,Me,100,EUR,You,100,EUR\nT2,CANCELLED,OUT,2026-01-05 10:00:00,0,EUR,Me,5,EUR,You,5,EUR\nT3,COMPLETED,NEUTRAL,2026-01-05 10:00:00,0,EUR,Me,5,EUR,Me,5,USD\n')
    assert [(r["reference"], str(r["amount"])) for r in profiles.read_export(spark, str(tmp_path / "wallet.csv")).collect()] == [("T1", "-101.50")]
    (tmp_path / "own.csv").write_text("Date,Account,Description,Counterparty,Amount,Currency\n2026-01-05,A,lunch,Cafe,-12.50,EUR\n")
    assert profiles.read_export(spark, str(tmp_path / "own.csv")).first()["counterparty_name"] == "Cafe"
    (tmp_path / "copy.csv").write_bytes((tmp_path / "own.csv").read_bytes())
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in profiles.import_files(spark, str(tmp_path)).collect()}
    assert status["copy.csv"] == "pending" and status["own.csv"] == "duplicate_file" and status["x.pdf"] == "unsupported"


def test_statement_lines_are_folded(spark):
    page = "Statement\n01-02-2026 Shop A 12,50\n  City\n  Ref 7\n02-02-2026 Shop B 3,00\n"
    rows = profiles.fold_statement(spark.createDataFrame([("p", page)], "path string, text string"), r"^(\d\d-\d\d-\d{4}) (.*) (\d+,\d\d)$").orderBy("line").collect()
    assert [(r["fields"], r["details"]) for r in rows] == [(["01-02-2026", "Shop A", "12,50"], "City Ref 7"), (["02-02-2026", "Shop B", "3,00"], "")]


def test_duplicates_and_merges(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 2)], "id long, fingerprint string, file_seq int")
    assert {r["id"]: r["is_duplicate"] for r in detect.duplicate_flags(rows).collect()} == {1: False, 2: False, 3: True, 4: False}
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "id long, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "id long, v string")
    merged = lambda keep: {r["id"]: r["v"] for r in detect.merge_keyed(old, new, ["id"], keep).collect()}
    assert merged("new") == {1: "o", 2: "n", 3: "n"} and merged("existing") == {1: "o", 2: "o", 3: "n"}


def test_stream_takes_each_fingerprint_once_and_closes_days(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 5), "a", "income", 5.0), (dt.datetime(2026, 1, 5), "a", "income", 5.0), (dt.datetime(2026, 2, 1), "b", "income", 7.0), (dt.datetime(2026, 4, 1), "c", "income", 9.0)]
    schema = "event_time timestamp, fingerprint string, economic_class string, amount double"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = ingest.day_stream(stream).writeStream.outputMode("append").format("memory").queryName("closed").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["month"], r["n"], r["total"]) for r in ingest.monthly_batch(spark.table("closed")).collect()}
    assert got <= {("2026-01", 1, 5.0), ("2026-02", 1, 7.0)} and ("2026-01", 1, 5.0) in got  # the last day is still open


def test_facade_on_an_empty_and_a_small_ledger(spark):
    for frame in (ledger(spark, MONTH), ledger(spark, MONTH).limit(0)):
        book = Ledger(frame)
        for answer in (book.snapshots(), book.fire(), book.yearly(), book.spending(), book.buckets(), book.trends(), book.insights(), book.recurring(), book.data_health(), book.review_items(), book.month_audit("2026-01"), book.search(text="shop")):
            answer.collect()
    assert [r["link_state"] for r in analytics.month_audit(ledger(spark, MONTH), "2026-01").collect()] == ["open"] * 4
