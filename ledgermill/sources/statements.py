"""Texts of statements and yearly overviews: rows and balance anchors by patterns, by the places of columns, and by what lines before them said.

A text is a row (path, text), brought by whatever reads the files. A statement has a few pages, so one task may follow its lines; texts are spread over tasks.
Facts of a whole text (period, account, header offset) are found once a text and joined to its lines as columns. A transaction's line begins a record; the lines up to the
next one are its details, without what every page repeats. Rows whose date can't be read have a null txn_date, texts without what their kind must say an error (`unreadable`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

MONEY = "decimal(18,2)"
_AMOUNT = r"(?:\d{1,3}\.)*\d+,\d{2}"
#: Words and forms of the statements' lines.
CARD_LINE = rf"^\s*(\d{{2}}-\d{{2}}-\d{{4}})\s+(.+?)\s{{2,}}(Betaling|Ontvangst|Incasso)\s+([+\-]?\s*{_AMOUNT})\s*$"
CARD_FURNITURE = ("pagina ", "Pagina ", "Afschrift Creditcard", "Geboekt op", "Overeenkomstnummer", "Periode")
CARD_PERIOD = r"Periode\s+(\d{2}-\d{2}-\d{4})\s+t/m\s+(\d{2}-\d{2}-\d{4})"
CARD_AGREEMENT = r"Overeenkomstnummer\s+([\d\s]{8,})"
CARD_SETTLEMENT = r"Op\s+(\d{2}-\d{2}-\d{4})\s+schrijven wij\s+([\d.]+,\d{2})\s+euro af"
CARD_ACCOUNT = "ING credit card"
BANK_LINE = rf"^\s*(\d{{2}}-\d{{2}})\s+(.+?)\s{{2,}}([+\-]?{_AMOUNT})\s*$"
BANK_FURNITURE = ("Rekeningafschrift", "Soort rekening", "PRIVEREKENING", "Boekdatum", "(Rentedatum)", "ABN AMRO Bank N.V.", "K.v.K", "BTW nr.", "Pagina")
BANK_ACCOUNT = r"\b(NL\d{2}\s?ABNA(?:\s?\d){10})\b"
BANK_BALANCES = r"(?s)Vorig saldo\s+Nieuw saldo.*?\n\s*([\d.]+,\d{2})\s+\+/CREDIT\s+([\d.]+,\d{2})\s+\+/CREDIT"
DEBIT_HEADER, CREDIT_HEADER, DEFAULT_OFFSET, SLACK = "Bedrag af", "Bedrag bij", 95, 5
CUTOFF = "2025-01-03"
OVERVIEW_YEAR = r"(?i)Financieel\s+Jaaroverzicht\s+(20\d{2})\b"
OVERVIEW_ACCOUNT = BANK_ACCOUNT + r"[^\n]*?([\d.]+,\d{2})\s+([\d.]+,\d{2})"
OVERVIEW_ACCOUNT_BELOW = BANK_ACCOUNT + r"[^\n]*\n\s*([\d.]+,\d{2})\s+([\d.]+,\d{2})"
MORTGAGE_NUMBER, LOAN_PART = r"Hypotheeknummer\s+([\d.]+)", r"Leningdeelnr:\s*(\d+)"
DATE = r"\b(\d{2}-\d{2}-\d{4})\b"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match; null without a match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def _money(text: Column) -> Column:
    """The size of an amount with dots for thousands and a comma."""
    return F.replace(F.regexp_replace(text, r"[.\s+\-]", ""), F.lit(","), F.lit(".")).cast(MONEY)


def _date(text: Column) -> Column:
    return F.try_to_date(text, "dd-MM-yyyy")


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lines_of(texts: DataFrame, *facts: str) -> DataFrame:
    """(path, row_number, line) with the text's facts; lines are numbered from 1."""
    split = F.split("text", "\r\n|\n|\r|\f")
    return texts.select("path", *facts, F.posexplode(split).alias("place", "line")).withColumn("row_number", F.col("place") + 1).drop("place")


def folded(lines: DataFrame, head: Column, furniture: tuple[str, ...], *facts: str) -> DataFrame:
    """One row a head line, with `details`: the lines after it up to the next head, without empty ones and furniture."""
    bare = F.trim("line")
    skipped = bare == ""
    for start in furniture:
        skipped = skipped | F.startswith(bare, F.lit(start))
    w = Window.partitionBy("path").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"is_head": head, "bare": bare}).withColumn("record", F.last(F.when(F.col("is_head"), F.col("row_number")), ignorenulls=True).over(w))
    kept = marked.where(F.col("record").isNotNull() & (F.col("is_head") | ~skipped))
    rest = F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("row_number", "bare"))))
    rows = kept.groupBy("path", "record", *facts).agg(F.max(F.when(F.col("is_head"), F.rtrim("line"))).alias("line"), rest.alias("rest"))
    return rows.select("path", F.col("record").alias("row_number"), *facts, "line", F.array_join(F.transform("rest", lambda x: x["bare"]), " ").alias("details"))


def card_rows(texts: DataFrame) -> DataFrame:
    """Transactions of card statements: payments are outflows, all else inflows, unless the amount has a minus."""
    text = F.col("text")
    facts = {
        "period_start": _date(_found(text, CARD_PERIOD)), "period_end": _date(_found(text, CARD_PERIOD, 2)), "account_name": F.coalesce(F.regexp_replace(_found(text, CARD_AGREEMENT), r"\s+", ""), F.lit(CARD_ACCOUNT)),
        "settlement_date": _date(_found(text, CARD_SETTLEMENT)), "settlement_amount": _money(_found(text, CARD_SETTLEMENT, 2)),
    }
    rows = folded(lines_of(texts.withColumns(facts), *facts), F.regexp_like(F.rtrim("line"), F.lit(CARD_LINE)), CARD_FURNITURE, *facts)
    part = lambda i: F.regexp_extract("line", CARD_LINE, i)
    merchant, kind, day = _spaced(part(2)), part(3), _date(part(1))
    minus = (kind == "Betaling") | F.startswith(F.trim(part(4)), F.lit("-"))
    return rows.select(
        "path", "row_number", F.lit("charge_card").alias("institution"), "account_name", day.alias("txn_date"), day.alias("booking_date"), (F.when(minus, -1).otherwise(1) * _money(part(4))).cast(MONEY).alias("amount"), F.lit("EUR").alias("currency"),
        merchant.alias("counterparty_name"), F.lit("").alias("counterparty_account"), _joined(merchant, F.col("details")).alias("description"), F.concat_ws(":", "path", "row_number").alias("reference"), kind.alias("kind"), "period_start", "period_end", "settlement_date", "settlement_amount",
    )


def _bank_facts(texts: DataFrame) -> DataFrame:
    text = F.col("text")
    heads = F.filter(F.split(text, "\r\n|\n|\r|\f"), lambda x: F.contains(x, F.lit(DEBIT_HEADER)) & F.contains(x, F.lit(CREDIT_HEADER)))
    header = F.try_element_at(heads, F.lit(1))
    offset = F.coalesce(F.instr(header, CREDIT_HEADER) - 1, F.lit(DEFAULT_OFFSET))
    return texts.withColumns({"statement_date": _date(_found(text, DATE)), "account_name": F.coalesce(F.regexp_replace(_found(text, BANK_ACCOUNT), r"\s+", ""), F.lit("ABN PDF account")), "offset": offset})


def bank_rows(texts: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Transactions of bank statements before the cutoff, from which on exports have them.

    An amount that begins at the credit column's header, or SLACK characters before it, is an inflow. A month more than half a year after the statement's is
    of the year before.
    """
    rows = folded(lines_of(_bank_facts(texts), "statement_date", "account_name", "offset"), F.regexp_like(F.rtrim("line"), F.lit(BANK_LINE)), BANK_FURNITURE, "statement_date", "account_name", "offset")
    part = lambda i: F.regexp_extract("line", BANK_LINE, i)
    said, amount = _spaced(part(2)), part(3)
    credit = F.length("line") - F.length(amount) >= F.greatest(F.lit(0), F.col("offset") - SLACK)
    year = F.year("statement_date") - F.when(F.substring(part(1), 4, 2).cast("int") > F.month("statement_date") + 6, 1).otherwise(0)
    day = _date(F.concat_ws("-", part(1), F.lpad(year.cast("string"), 4, "0")))
    rows = rows.select(
        "path", "row_number", F.lit("booked").alias("institution"), "account_name", day.alias("txn_date"), F.when(credit, _money(amount)).otherwise(-_money(amount)).cast(MONEY).alias("amount"), F.lit("EUR").alias("currency"), said.alias("said"),
        _joined(said, F.col("details")).alias("description"), F.when(credit, "credit").otherwise("debit").alias("amount_column"), "statement_date",
    )
    ibans = F.filter(t.extract_ibans(F.col("description")), lambda x: x != F.col("account_name"))
    named = F.coalesce(F.nullif(t.normalize_merchant(F.col("description")), F.lit("")), F.col("said"))
    kept = rows.where(F.col("txn_date").isNull() | (F.col("txn_date") < F.lit(cutoff).cast("date")))
    return kept.select(
        "path", "row_number", "institution", "account_name", "txn_date", F.col("txn_date").alias("booking_date"), "amount", "currency", named.alias("counterparty_name"), F.coalesce(F.try_element_at(ibans, F.lit(1)), F.lit("")).alias("counterparty_account"),
        "description", F.concat_ws(":", "path", "row_number").alias("reference"), "amount_column", "statement_date",
    )


def _anchors(rows: DataFrame, *anchors: tuple[Column, Column, Column, str, float]) -> DataFrame:
    """(path, account_name, role, observation_date, balance_type, balance, confidence) of anchors (account, date, balance, type, confidence); those without a balance are left out."""
    each = [F.struct(account.alias("account_name"), day.alias("observation_date"), F.lit(kind).alias("balance_type"), balance.cast(MONEY).alias("balance"), F.lit(sure).alias("confidence")) for account, day, balance, kind, sure in anchors]
    return rows.select("path", "role", F.explode(F.array(*each)).alias("a")).where("a.balance is not null").select("path", "a.account_name", "role", "a.observation_date", "a.balance_type", "a.balance", "a.confidence")


def bank_anchors(texts: DataFrame) -> DataFrame:
    """The balances before and after each bank statement."""
    text = F.col("text")
    rows = _bank_facts(texts).withColumn("role", F.lit("checking"))
    balance = lambda i: _money(_found(text, BANK_BALANCES, i))
    return _anchors(rows, (F.col("account_name"), F.col("statement_date"), balance(1), "opening_pdf_statement", 0.92), (F.col("account_name"), F.col("statement_date"), balance(2), "closing_pdf_statement", 0.96))


def overview_anchors(texts: DataFrame) -> DataFrame:
    """Year-end balances of yearly overviews: the account's, and each loan part's with the interest paid for it.

    Sections are nested: a loan part belongs to the mortgage whose number stands last before it, else to the first one of the text.
    """
    text = F.col("text")
    dated = texts.withColumn("year", _found(text, OVERVIEW_YEAR).cast("int")).where("year is not null")
    before, after = F.make_date(F.col("year") - 1, F.lit(12), F.lit(31)), F.make_date(F.col("year"), F.lit(12), F.lit(31))
    either = lambda i: F.coalesce(_found(text, OVERVIEW_ACCOUNT, i), _found(text, OVERVIEW_ACCOUNT_BELOW, i))
    account = F.regexp_replace(either(1), r"\s+", "")
    own = _anchors(dated.withColumn("role", F.lit("checking")), (account, before, _money(either(2)), "year_end", 0.96), (account, after, _money(either(3)), "year_end", 0.98))
    lines = lines_of(dated.withColumn("first_number", _found(text, MORTGAGE_NUMBER)), "year", "first_number")
    w = Window.partitionBy("path").orderBy("row_number").rowsBetween(Window.unboundedPreceding, 0)
    number = F.coalesce(F.last(_found(F.col("line"), MORTGAGE_NUMBER), ignorenulls=True).over(w), "first_number", F.lit("ABN mortgage"))
    parts = lines.withColumn("number", number).withColumns({"loan": _found(F.col("line"), LOAN_PART), "amounts": F.regexp_extract_all("line", F.lit(r"(-?[\d.]+,\d{2})"), 1)}).where("loan is not null and size(amounts) >= 2")
    signed = lambda i: F.when(F.startswith(F.get("amounts", F.lit(i)), F.lit("-")), -1).otherwise(1) * _money(F.get("amounts", F.lit(i)))
    name = F.concat_ws(":", "number", "loan")
    loans = _anchors(parts.withColumn("role", F.lit("mortgage")), (name, before, signed(0), "year_end", 0.96), (name, after, signed(1), "year_end", 0.98), (name, after, signed(2), "paid_interest", 0.9))
    return own.unionByName(loans)


def unreadable(texts: DataFrame, kind: str) -> DataFrame:
    """(path, error) of texts that lack what their kind (`bank` or `overview`) must say."""
    need, why = {"bank": (DATE, "no statement date"), "overview": (OVERVIEW_YEAR, "no overview year")}[kind]
    return texts.where(~F.coalesce(F.regexp_like("text", F.lit(need)), F.lit(False))).select("path", F.lit(why).alias("error"))
