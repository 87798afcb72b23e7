"""Statement texts with odd lines: furniture, missing facts, dates that aren't, columns at the edge."""

from __future__ import annotations

from datetime import date

from ledgermill.sources import statements


def texts(spark, *values):
    return spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(values)], "path string, text string")


def test_card_lines(spark):
    page = "Saldo\n 05-01-2024  Shop \t A    Betaling   1.234,50\r\n  more \n\npagina 2\n Geboekt op x\nlast\n06-01-2024 B  Ontvangst  - 2,00\n31-02-2024 C  Incasso  +3,00\n07-01-2024 D Betaling 4,00"
    rows = statements.card_rows(texts(spark, page, "", None)).orderBy("row_number").collect()
    assert [(r["row_number"], r["txn_date"], float(r["amount"]), r["description"]) for r in rows] == [(2, date(2024, 1, 5), -1234.5, "Shop A more last"), (8, date(2024, 1, 6), -2.0, "B"), (9, None, 3.0, "C 07-01-2024 D Betaling 4,00")]
    assert rows[0]["account_name"] == statements.CARD_ACCOUNT and rows[0]["period_start"] is None


def test_bank_columns_years_and_cutoff(spark):
    head = "Datum 10-02-2024\nBoekdatum" + " " * 20 + "Bedrag af" + " " * 11 + "Bedrag bij"  # credit from 49 on, so from 44
    line = lambda day, at, amount: f"{day} Shop".ljust(at) + amount
    page = "\n".join([head, line("01-02", 43, "1,00"), line("02-02", 44, "2,00"), line("03-08", 60, "-3,00"), line("04-09", 20, "4,00"), "  detail", "Pagina 3"])
    rows = statements.bank_rows(texts(spark, page), "2030-01-01").orderBy("row_number").collect()
    assert [(r["txn_date"], float(r["amount"]), r["amount_column"]) for r in rows] == [(date(2024, 2, 1), -1.0, "debit"), (date(2024, 2, 2), 2.0, "credit"), (date(2024, 8, 3), 3.0, "credit"), (date(2023, 9, 4), -4.0, "debit")]
    assert rows[3]["description"] == "Shop detail"
    kept = statements.bank_rows(texts(spark, page), "2024-02-02").collect()
    assert sorted(r["txn_date"] for r in kept) == [date(2023, 9, 4), date(2024, 2, 1)]
    assert [tuple(r) for r in statements.unreadable(texts(spark, page, "no date", None), "bank").orderBy("path").collect()] == [("p1", "no statement date"), ("p2", "no statement date")]


def test_overview_sections(spark):
    page = "Financieel Jaaroverzicht 2023\nLeningdeelnr: 1  10,00 9,00\nHypotheeknummer 1.2\nLeningdeelnr: 2  1.010,00 -9,00 3,00\nLeningdeelnr: 3  5,00\nHypotheeknummer 7\nLeningdeelnr: 4 1,00 2,00"
    rows = {(r["account_name"], str(r["observation_date"]), r["balance_type"]): float(r["balance"]) for r in statements.overview_anchors(texts(spark, page, "other", None)).collect()}
    assert rows == {
        ("1.2:1", "2022-12-31", "year_end"): 10.0, ("1.2:1", "2023-12-31", "year_end"): 9.0, ("1.2:2", "2022-12-31", "year_end"): 1010.0, ("1.2:2", "2023-12-31", "year_end"): -9.0, ("1.2:2", "2023-12-31", "paid_interest"): 3.0,
        ("7:4", "2022-12-31", "year_end"): 1.0, ("7:4", "2023-12-31", "year_end"): 2.0,
    }
