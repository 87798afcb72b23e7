"""Bank, card and broker exports as one canonical schema: a profile is a mapping of columns, chosen by the file's header or name.

Files are read by Spark (whole files as rows, see `ingest`, or one delimited file at a time); only headers come to the driver, to choose a
profile. Rows a profile skips are filtered; amounts and dates that can't be read are null, and `ingest` fails the file that has them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t

CANONICAL = ("institution", "account", "txn_date", "booking_date", "amount", "currency", "counterparty_name", "counterparty_account", "description", "reference", "opening_balance", "closing_balance", "resulting_balance", "native_amount", "native_currency", "source_amount", "source_currency", "target_amount", "target_currency", "exchange_rate")
#: The columns of a headerless tab file.
TAB_HEADER = ("account_number", "currency", "transaction_date", "opening_balance", "closing_balance", "booking_date", "amount", "description")


@dataclass(frozen=True)
class Profile:
    """needs: normalised headers that tell this layout; make: canonical columns from the file's; keep: which rows count."""

    name: str
    needs: tuple[frozenset[str], ...]
    make: Callable[[list[str]], dict[str, Column]]
    keep: Callable[[list[str]], Column] | None = None


def normalize_header(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower())).strip("_")


def normalize_headers(names: list[str]) -> list[str]:
    """Lower case with underscores; an unnamed column after a change or balance is its amount; repeats are numbered."""
    out: list[str] = []
    for i, name in enumerate(names):
        own = normalize_header(name)
        if not own:
            before = out[-1] if out else ""
            own = f"{before}_amount" if before.split("_")[-1] in ("change", "balance") else f"column_{i}"
        while own in out:
            own += "_2"
        out.append(own)
    return out


def delimiter(lines: list[str]) -> str:
    """Tab if each line has two and more, else semicolon likewise, else the more frequent of comma, semicolon and tab."""
    lines = [x for x in lines if x.strip()][:10]
    for sep in ("\t", ";"):
        if lines and all(x.count(sep) >= 2 for x in lines):
            return sep
    return max((",", ";", "\t"), key=lambda sep: sum(x.count(sep) for x in lines))


def headerless(cells: list[str]) -> bool:
    """Whether a first row is data of a headerless tab file."""
    tests = (r"\d{6,}", r"[A-Z]{3}", r"\d{8}", r"-?[\d.]+,\d{2}", r"-?[\d.]+,\d{2}", r"\d{8}", r"-?[\d.]+,\d{2}")
    return len(cells) >= 8 and all(re.fullmatch(p, c.strip()) for p, c in zip(tests, cells))


def _fields(columns: list[str], **names: tuple[str, ...]) -> dict[str, Column]:
    return {k: t.first_value(columns, *v) for k, v in names.items()}


def _checking(columns: list[str]) -> dict[str, Column]:
    x = _fields(
        columns,
        account=("rekening", "account"), counterparty_account=("tegenrekening", "counterparty"), name=("naam_omschrijving", "name_description", "description"), note=("mededelingen", "notifications"),
        day=("datum", "date"), amount=("bedrag_eur", "amount_eur", "amount"), flag=("af_bij", "debit_credit"), balance=("resulting_balance", "saldo_na_mutatie"), currency=("currency",),
    )
    other = F.coalesce(x["counterparty_account"], F.get(t.extract_ibans(x["note"], x["account"]), 0))
    return {
        "account": x["account"], "txn_date": t.parse_date(x["day"]), "amount": t.parse_amount(x["amount"], x["flag"]), "currency": F.coalesce(x["currency"], F.lit("EUR")), "counterparty_name": x["name"],
        "counterparty_account": other, "description": F.concat_ws(" ", x["name"], x["note"]), "resulting_balance": t.parse_amount(x["balance"]),
    }


def _booked(columns: list[str]) -> dict[str, Column]:
    x = _fields(
        columns,
        account=("rekeningnummer", "account_number"), other=("tegenrekeningnummer",), name=("naam_tegenpartij",), note=("omschrijving", "description"), day=("transaction_date", "boekdatum"), booked=("booking_date", "boekdatum"),
        amount=("bedrag", "amount"), currency=("valuta", "currency"), opening=("opening_balance",), closing=("closing_balance",),
    )
    return {
        "account": x["account"], "txn_date": t.parse_date(x["day"]), "booking_date": t.parse_date(x["booked"]), "amount": t.parse_amount(x["amount"]), "currency": F.coalesce(x["currency"], F.lit("EUR")),
        "counterparty_name": x["name"], "counterparty_account": F.coalesce(x["other"], F.get(t.extract_ibans(x["note"], x["account"]), 0)), "description": x["note"], "opening_balance": t.parse_amount(x["opening"]), "closing_balance": t.parse_amount(x["closing"]),
    }


def _wallet(columns: list[str]) -> dict[str, Column]:
    x = _fields(
        columns,
        id=("id",), direction=("direction",), day=("finished_on", "created_on"), source=("source_amount_after_fees",), source_currency=("source_currency",), fee=("source_fee_amount",), fee_currency=("source_fee_currency",),
        target=("target_amount_after_fees",), target_currency=("target_currency",), rate=("exchange_rate",), source_name=("source_name",), target_name=("target_name",), reference=("reference",), note=("note",),
    )
    out = F.upper(x["direction"]) == "OUT"
    fee = F.when(x["fee_currency"] == x["source_currency"], F.coalesce(t.parse_amount(x["fee"]), F.lit(0))).otherwise(0)
    amount = F.when(out, -F.abs(t.parse_amount(x["source"]) + fee)).otherwise(F.abs(t.parse_amount(x["target"])))
    return {
        "account": F.lit("wallet"), "txn_date": t.parse_date(x["day"]), "amount": amount.cast("decimal(18,2)"), "currency": F.when(out, x["source_currency"]).otherwise(x["target_currency"]),
        "counterparty_name": F.when(out, x["target_name"]).otherwise(x["source_name"]), "description": F.concat_ws(" ", x["note"], x["reference"]), "reference": x["id"],
        "native_amount": amount, "native_currency": F.when(out, x["source_currency"]).otherwise(x["target_currency"]), "source_amount": t.parse_amount(x["source"]), "source_currency": x["source_currency"],
        "target_amount": t.parse_amount(x["target"]), "target_currency": x["target_currency"], "exchange_rate": x["rate"].try_cast("double"),
    }


def _charge_card(columns: list[str]) -> dict[str, Column]:
    x = _fields(columns, account=("rekening",), day=("datum",), name=("omschrijving",), more=("aanvullende_informatie",), amount=("bedrag",), reference=("referentie",))
    return {"account": x["account"], "txn_date": F.try_to_date(x["day"], "M/d/yyyy"), "amount": -t.parse_amount(x["amount"]), "currency": F.lit("EUR"), "counterparty_name": x["name"], "description": F.concat_ws(" ", x["name"], x["more"]), "reference": x["reference"]}


def _broker(columns: list[str]) -> dict[str, Column]:
    x = _fields(columns, day=("date", "datum", "settle_date"), name=("description", "omschrijving"), amount=("change_amount", "mutatie_amount", "amount"), currency=("change", "mutatie", "currency"), reference=("order_id",))
    return {"account": F.lit("broker"), "txn_date": t.parse_date(x["day"]), "amount": t.parse_amount(x["amount"]), "currency": F.coalesce(x["currency"], F.lit("EUR")), "description": x["name"], "reference": x["reference"]}


def _activity(columns: list[str]) -> dict[str, Column]:
    x = _fields(
        columns,
        day=("date", "datum", "reportdate", "trade_date"), amount=("amount", "cash", "proceeds", "net_amount", "bedrag"), name=("description", "omschrijving", "activity_description"), kind=("type", "activity_type"),
        symbol=("symbol",), account=("account", "clientaccountid", "accountid"), currency=("currency", "valuta"), reference=("transactionid", "reference"),
    )
    said = F.nullif(F.concat_ws(" ", x["name"], x["kind"], x["symbol"]), F.lit(""))
    return {
        "account": F.coalesce(x["account"], F.lit("brokerage")), "txn_date": t.parse_date(x["day"]), "booking_date": t.parse_date(x["day"]), "amount": t.parse_amount(x["amount"]), "currency": F.coalesce(x["currency"], F.lit("EUR")),
        "counterparty_name": F.lit("Brokerage"), "description": F.coalesce(said, F.lit("Brokerage transaction")), "reference": x["reference"],
    }


def _generic(columns: list[str]) -> dict[str, Column]:
    x = _fields(
        columns,
        account=("account", "account_number", "rekening"), day=("date", "transaction_date", "datum"), name=("counterparty", "name", "payee"), other=("counter_account", "counterparty_account"), note=("description", "memo", "omschrijving"),
        amount=("amount", "bedrag", "value"), currency=("currency", "valuta"), reference=("reference", "id"),
    )
    return {"account": x["account"], "txn_date": t.parse_date(x["day"]), "amount": t.parse_amount(x["amount"]), "currency": F.coalesce(x["currency"], F.lit("EUR")), "counterparty_name": x["name"], "counterparty_account": x["other"], "description": x["note"], "reference": x["reference"]}


def _completed(columns: list[str]) -> Column:
    return (F.upper(F.trim("status")) == "COMPLETED") & F.upper(F.trim("direction")).isin("IN", "OUT")


PROFILES = (
    Profile("checking", (frozenset({"af_bij"}), frozenset({"debit_credit"})), _checking),
    Profile("booked", (frozenset({"boekdatum"}), frozenset({"opening_balance", "closing_balance", "transaction_date"})), _booked),
    Profile("activity", (frozenset({"clientaccountid"}), frozenset({"asset_category"})), _activity),
    Profile("wallet", (frozenset({"direction", "status", "source_currency"}),), _wallet, _completed),
    Profile("charge_card", (frozenset({"kaartlid"}), frozenset({"referentie", "bedrag"})), _charge_card, lambda c: F.try_to_date(F.trim("datum"), "M/d/yyyy").isNotNull()),
    Profile("broker", (frozenset({"change", "change_amount"}), frozenset({"mutatie", "mutatie_amount"})), _broker, lambda c: _broker(c)["amount"].isNotNull()),
    Profile("generic", (), _generic),
)


def detect_profile(columns: list[str], requested: str | None = None) -> Profile:
    """The requested profile, or the first whose headers the file has, or the generic one."""
    for p in PROFILES:
        if p.name == requested or (requested is None and any(need <= set(columns) for need in p.needs)):
            return p
    return PROFILES[-1]


class _Asked(list):
    """A list of columns that has every name, and keeps those it was asked for."""

    def __contains__(self, name: object) -> bool:
        self.append(name)
        return True


def asked(profile: Profile) -> list[str]:
    """The columns that a profile reads, in whatever layouts they are."""
    names = _Asked()
    profile.make(names)
    return sorted({*iter(names), *(x for need in profile.needs for x in need)})


def canonical_maps(rows: DataFrame, profile: Profile, names: set[str]) -> DataFrame:
    """As canonical, of rows whose cells are a map `raw` by normalised name, of these at most; so all layouts of a profile go together."""
    needed = {x for need in profile.needs for x in need}
    columns = [c for c in asked(profile) if c in names or c in needed]
    # A row at a time through a generator, so that filters on cells don't go below what makes them, and columns are made once.
    made = F.struct(F.col("raw").alias("__raw"), *[F.try_element_at("raw", F.lit(c)).alias(c) for c in columns])
    wide = rows.select(*[c for c in rows.columns if c.startswith("__")], F.inline(F.array(made)))
    return canonical(wide, profile).drop("raw").withColumnRenamed("__raw", "raw")


def canonical(rows: DataFrame, profile: Profile) -> DataFrame:
    """The canonical columns of raw text columns (normalised names), with the raw row kept as a map; columns named __x are carried."""
    carried, columns = [c for c in rows.columns if c.startswith("__")], [c for c in rows.columns if not c.startswith("__")]
    if profile.keep is not None:
        rows = rows.where(profile.keep(columns))
    made = {"institution": F.lit(profile.name), **profile.make(columns)}
    typed = {c: made.get(c, F.lit(None)).cast("date" if c.endswith("_date") else "decimal(18,2)" if c.endswith(("amount", "balance")) else "double" if c == "exchange_rate" else "string") for c in CANONICAL}
    raw = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))]).alias("raw")
    return rows.select(*carried, *[v.alias(k) for k, v in typed.items()], raw)


def read_export(spark: SparkSession, path: str, requested: str | None = None) -> DataFrame:
    """One delimited export as canonical rows; blank rows are dropped, short rows padded with nulls."""
    head = [r["value"] for r in spark.read.text(path).limit(11).collect()]
    sep = delimiter(head)
    cells = head[0].lstrip("﻿").split(sep) if head else []
    if sep == "\t" and headerless(cells):
        rows = spark.read.csv(path, sep=sep, schema=", ".join(f"`{c}` string" for c in TAB_HEADER), mode="PERMISSIVE")
    else:
        rows = spark.read.csv(path, sep=sep, header=True, mode="PERMISSIVE", multiLine=False, quote='"', escape='"')
        rows = rows.toDF(*normalize_headers([c.lstrip("﻿") if not re.fullmatch(r"_c\d+", c) else "" for c in rows.columns]))
    rows = rows.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in rows.columns]).isNotNull())
    return canonical(rows, detect_profile(rows.columns, requested))


def read_sections(spark: SparkSession, path: str, section: str = "Deposits & Withdrawals") -> DataFrame:
    """The cash rows of a broker's sectioned statement; totals are skipped, the account is that of its information section."""
    rows = spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(8)), mode="PERMISSIVE")
    account = rows.where((F.col("c0") == "Account Information") & (F.col("c2") == "Account")).agg(F.first("c3").alias("account"))
    cash = rows.where((F.col("c0") == section) & (F.col("c1") == "Data") & ~F.startswith(F.coalesce("c2", F.lit("")), F.lit("Total")))
    cash = cash.crossJoin(F.broadcast(account))  # one row
    return cash.select(F.lit("broker").alias("institution"), "account", t.parse_date(F.col("c3")).alias("txn_date"), t.parse_amount(F.col("c5")).alias("amount"), F.col("c2").alias("currency"), F.col("c4").alias("description"))


def fold_statement(texts: DataFrame, line_pattern: str, text: str = "text", key: str = "path") -> DataFrame:
    """(key, line, fields, details): lines of a statement's text that match, each with the lines after it that don't, joined by spaces.

    fields are the pattern's groups. A statement is a few pages; the window is within one.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "value")).where("trim(value) <> ''")
    is_head = F.regexp_like("value", F.lit(line_pattern))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"head": is_head, "record": F.sum(is_head.cast("int")).over(w)}).where("record > 0")
    grouped = marked.groupBy(key, "record").agg(F.min("line").alias("line"), F.min_by("value", "line").alias("first"), F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", "value")))).alias("rest"))
    n = re.compile(line_pattern).groups
    fields = F.array(*[F.regexp_extract("first", line_pattern, i + 1) for i in range(n)])
    return grouped.select(key, "line", fields.alias("fields"), F.array_join(F.transform("rest", lambda x: F.trim(x["value"])), " ").alias("details"))


def import_files(spark: SparkSession, folder: str, imported: DataFrame | None = None) -> DataFrame:
    """Files of a folder tree with hash, status and hint: copies of imported or earlier files are duplicate_file, unknown kinds unsupported."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.sha2("content", 256).alias("file_hash"))
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(~F.startswith(name, F.lit(".")))
    if imported is not None:
        files = files.join(imported.where("status = 'imported'").select("file_hash", F.lit(True).alias("__known")).distinct(), "file_hash", "left")
    else:
        files = files.withColumn("__known", F.lit(None).cast("boolean"))
    rank = F.row_number().over(Window.partitionBy("file_hash").orderBy("path"))
    folders = F.lower("path")
    hint = F.when(F.contains(folders, F.lit("/savings/")), "savings").when(F.contains(folders, F.lit("/card/")), "credit_card").when(F.contains(folders, F.lit("/broker/")), "investment").otherwise("unknown")
    status = F.when(F.col("__known") | (rank > 1), "duplicate_file").when(~F.regexp_like(F.lower("path"), F.lit(r"\.(csv|tsv|tab|txt)$")), "unsupported").otherwise("pending")
    return files.select("path", "length", "file_hash", status.alias("status"), hint.alias("role_hint"))


def fx_rates(wide: DataFrame, date: str = "Date") -> DataFrame:
    """(rate_date, currency, eur_per_unit) from a table with a column for each currency."""
    currencies = [c for c in wide.columns if c != date]
    long = wide.unpivot([date], currencies, "currency", "per_eur")
    rate = F.col("per_eur").try_cast("double")
    return long.where(rate > 0).select(t.parse_date(F.col(date).cast("string")).alias("rate_date"), F.trim("currency").alias("currency"), F.try_divide(F.lit(1.0), rate).alias("eur_per_unit"))


def balance_observations(rows: DataFrame, key: str = "id") -> DataFrame:
    """A row for each balance that a transaction row carries."""
    kinds = ("opening_balance", "closing_balance", "resulting_balance")
    return rows.unpivot([key, "account", "txn_date"], list(kinds), "balance_type", "balance").where("balance is not null")
