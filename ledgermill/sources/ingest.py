"""Ingestion end to end: a folder of exports becomes accounts, transactions with fingerprints, amount details, balances and a status for each file.

A file is a row (path, content); its lines become rows in tasks. Only the distinct layouts (delimiter and header) come to the driver, to
choose each one's profile. A file that can't be read fails alone and is a row of `files` with its error; its rows are left out.
"""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.storage import cut, short_methods
from ..operators.matching import asof
from . import profiles

MONEY = "decimal(18,2)"
#: Lines of a file whose quotes are followed by one window; the state at their beginning is carried from those before.
PIECE = 4096
MAX_LAYOUTS = 10_000
#: Folders that the lines of layouts are dealt to.
KINDS = 16
MAX_ERROR = 1000
#: The bytes 0x80 to 0x9F of code page 1252, without the five it leaves undefined, and the characters they stand for.
_C1 = "".join(chr(x) for x in range(0x80, 0xA0) if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: Parts of a file's name that tell its profile where its header doesn't.
NAME_HINTS = (("degiro", "broker"), ("ibkr", "activity"), ("ing", "checking"), ("abn", "booked"))
#: Folder names that tell an account's role.
FOLDER_ROLES = (("savings", "savings"), ("card", "credit_card"), ("broker", "investment"), ("wallet", "wise"), ("checking", "checking"))
#: Roles of accounts that nothing else tells, by profile.
PROFILE_ROLES = {"checking": "checking", "booked": "checking", "wallet": "wise", "charge_card": "credit_card", "broker": "investment", "activity": "investment"}


@dataclass(frozen=True)
class Imported:
    files: DataFrame
    transactions: DataFrame
    amount_details: DataFrame
    balances: DataFrame
    accounts: DataFrame


def decoded(content: Column) -> Column:
    """A file's text: UTF-8 if it is valid, else code page 1252, else Latin-1; without a byte order mark."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, _C1, _CP1252)
    other = F.when(F.regexp_like(latin, F.lit("[\\x81\\x8d\\x8f\\x90\\x9d]")), latin).otherwise(windows)
    return F.regexp_replace(F.coalesce(utf8, other), "^﻿", "")


def delimiter(head: Column) -> Column:
    """Tab if each of the first lines has two and more, else semicolon likewise, else the more frequent of comma, semicolon and tab."""
    count = lambda sep: F.transform(head, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
    total = lambda sep: F.aggregate(count(sep), F.lit(0), lambda a, b: a + b)
    comma, semicolon, tab = total(","), total(";"), total("\t")
    return (
        F.when(F.array_min(count("\t")) >= 2, "\t").when(F.array_min(count(";")) >= 2, ";").when((comma >= semicolon) & (comma >= tab), ",").when(semicolon >= tab, ";").otherwise("\t")
    )


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder tree's files, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.where(~F.startswith(F.element_at(F.split("path", "/"), -1), F.lit(".")))


def role_of(path: Column) -> Column:
    """The role that a file's folders tell; null if none does."""
    parts = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    has = lambda part: F.exists(parts, lambda x: F.contains(x, F.lit(part)))
    out = F.lit(None).cast("string")
    for part, role in reversed(FOLDER_ROLES):
        out = F.when(has(part), role).otherwise(out)
    return out


def file_states(files: DataFrame, imported: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, content, file_hash) of files, written once, and (path, file_hash, status, role_hint): copies of imported or earlier files (in order of path) are duplicate_file, unknown kinds unsupported.

    Contents stay where they are; states follow from paths and hashes alone.
    """
    contents = cut(files.select("path", "content", F.sha2("content", 256).alias("file_hash")))
    rows = contents.select("path", "file_hash")
    known = F.lit(False)
    first = rows.groupBy("file_hash").agg(F.min("path").alias("first_path"))
    if imported is not None:
        seen = imported.where("status = 'imported'").select("file_hash", F.lit(True).alias("known")).distinct()
        first, known = first.join(seen, "file_hash", "left"), F.coalesce("known", F.lit(False))
    rows = rows.join(first, "file_hash")
    supported = F.regexp_like(F.lower("path"), F.lit(r"\.(csv|tsv|tab|txt)$"))
    status = F.when(known | (F.col("path") != F.col("first_path")), "duplicate_file").when(~supported, "unsupported").otherwise("pending")
    return contents, cut(rows.select("path", "file_hash", status.alias("status"), role_of(F.col("path")).alias("role_hint")))


def _leaves_open(text: Column, sep: Column) -> Column:
    """Whether a text that begins outside quotes ends inside a quoted cell: what is left after whole quoted cells begins one that doesn't end."""
    rest = F.regexp_replace(F.concat(sep, text), F.concat(F.lit("("), sep, F.lit(r')"[^"]*+(?:""[^"]*+)*+"(?=[^"]|$)')), F.lit("$1"))
    return F.regexp_like(rest, F.concat(sep, F.lit(r'"[^"]*+(?:""[^"]*+)*+$')))


def joined_records(lines: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, sep, row_number, line): lines whose quoted cells go on in the next ones are joined with these, under the first one's number.

    What a line does to the state, outside or inside a quoted cell, is to keep it, to swap it, or to set it. So the state before a line follows from the last line that sets it and the
    number of swaps since. These are summed within pieces of a file, and over the pieces; so a file's lines are spread over tasks, and no task follows a whole file.
    """
    ahead = F.regexp_replace("line", r'^[^"]*+(?:""[^"]*+)*+"', "")  # what follows the quote that ends a cell open before
    closes = F.regexp_like("line", F.lit(r'^[^"]*+(?:""[^"]*+)*+"(?!")'))
    after_out, after_in = _leaves_open(F.col("line"), F.col("sep")), F.when(closes, _leaves_open(F.concat(F.lit("x"), ahead), F.col("sep"))).otherwise(F.lit(True))
    rows = lines.withColumns({"a": after_out.cast("int"), "b": after_in.cast("int"), "piece": F.floor((F.col("row_number") - 1) / piece)})
    rows = rows.withColumns({"swap": ((F.col("a") == 1) & (F.col("b") == 0)).cast("int"), "sets": F.when(F.col("a") == F.col("b"), F.col("a"))})
    # Within a piece: swaps so far, and at the last setting line its value less the swaps up to it.
    inside = Window.partitionBy("path", "piece").orderBy("row_number")
    rows = rows.withColumn("swaps", F.sum("swap").over(inside))
    rows = cut(rows.withColumn("base", F.last(F.col("sets") - F.col("swaps"), ignorenulls=True).over(inside)))
    ends = rows.groupBy("path", "piece").agg(F.max(F.struct("row_number", "swaps", "base")).alias("end")).select("path", "piece", "end.swaps", "end.base")
    over = Window.partitionBy("path").orderBy("piece")
    sums = ends.withColumn("total", F.sum("swaps").over(over))
    sums = sums.withColumn("whole_base", F.last(F.col("base") + F.col("swaps") - F.col("total"), ignorenulls=True).over(over))
    state = F.pmod(F.coalesce("whole_base", F.lit(0)) + F.col("total"), F.lit(2))
    heads = sums.select("path", "piece", F.coalesce(F.lag(state).over(over), F.lit(0)).alias("head"))
    rows = rows.join(heads, ["path", "piece"])
    after = F.pmod(F.coalesce(F.col("base"), F.col("head")) + F.col("swaps"), F.lit(2))
    before = F.coalesce(F.lag(after).over(inside), F.col("head"))
    starts = cut(rows.withColumn("begins", F.when(before == 0, F.col("row_number"))).select("path", "sep", "piece", "row_number", "line", "begins"))
    firsts = starts.groupBy("path", "piece").agg(F.max("begins").alias("latest"))
    earlier = firsts.select("path", "piece", F.last("latest", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    numbered = starts.join(earlier, ["path", "piece"]).withColumn("first", F.coalesce(F.last("begins", ignorenulls=True).over(inside), "earlier"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_number", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("path", "sep", F.col("first").alias("row_number")).agg(whole.alias("line"))


def lines_of(files: DataFrame) -> DataFrame:
    """(path, role_hint, named, sep, header, row_number, line, kind): the non-blank records of each file below its header, which is null for headerless ones; kind is a number by layout.

    A record is a line, or more of them where a quoted cell spans lines; only files that have such cells are followed line by line. What a
    file's lines have in common is found in the file's own row, so no line travels for it.
    """
    lines = F.transform(F.split("text", "\r\n|\n|\r"), lambda x, i: F.struct((i + 1).alias("row_number"), x.alias("line")))
    rows = files.select("path", decoded(F.col("content")).alias("text")).select("path", F.contains("text", F.lit('"')).alias("quoted"), lines.alias("lines"))
    rows = rows.withColumn("there", F.filter("lines", lambda x: F.trim(x["line"]) != "")).where("size(there) > 0")
    head = F.transform(F.slice("there", 1, 10), lambda x: x["line"])
    rows = rows.withColumn("sep", delimiter(head))
    rows = rows.withColumn("spans", F.col("quoted") & F.exists("lines", lambda x: F.contains(x["line"], F.lit('"')) & _leaves_open(x["line"], F.col("sep"))))
    #: As profiles.headerless, for the whole line.
    bare = (F.col("sep") == "\t") & F.regexp_like("first", F.lit(r"^\s*\d{6,18}\s*\t\s*[A-Za-z]{3}\s*\t\s*\d{8}\s*\t[^\t]*\t[^\t]*\t\s*\d{8}\s*\t\s*-?\d+([,.]\d+)?\s*\t"))
    facts = {"role_hint": role_of(F.col("path")), "named": _named_profile(F.col("path")), "kind": F.pmod(F.hash("sep", "header", _named_profile(F.col("path"))), F.lit(KINDS))}
    rows = rows.withColumn("first", F.get("there", F.lit(0))["line"]).withColumn("header", F.when(~F.col("spans") & ~bare, F.col("first"))).withColumns(facts)
    body = F.when(F.col("spans"), F.col("lines")).when(F.col("header").isNull(), F.col("there")).otherwise(F.slice("there", F.lit(2), F.size("there")))
    rows = rows.withColumn("kind", F.when(F.col("spans"), F.lit(-1)).otherwise(F.col("kind")))
    names = ["path", "role_hint", "named", "sep", "header", "row_number", "line", "kind"]
    rows = cut(rows.select("path", "role_hint", "named", "sep", "header", F.explode(body).alias("x"), "kind").select(*[f"x.{c}" if c in ("row_number", "line") else c for c in names]), by="kind")
    spanning = rows.where("kind = -1")
    if spanning.isEmpty():
        return rows
    records = cut(joined_records(spanning.select("path", "sep", "row_number", "line")).where(F.trim("line") != ""))
    firsts = records.groupBy("path").agg(F.min(F.struct("row_number", "line")).alias("top")).select("path", F.col("top.row_number").alias("first_row"), F.col("top.line").alias("first"))
    records = records.join(firsts, "path").withColumn("header", F.when(~bare, F.col("first"))).where("header is null or row_number > first_row").withColumns(facts)
    return rows.where("kind >= 0").unionByName(cut(records.select(*names), by="kind"))


def cells(line: Column, sep: str) -> Column:
    """All cells of a record, however many: quoted ones without their quotes, doubled quotes in them as one."""
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(rf'{sep}("[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^{sep}]*+)'), 1)
    whole = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"'
    bare = lambda x: F.concat(F.replace(F.regexp_extract(x, whole, 1), F.lit('""'), F.lit('"')), F.regexp_replace(x, whole, ""))
    unquoted = F.transform(found, lambda x: F.when(F.startswith(x, F.lit('"')), bare(x)).otherwise(x))
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(F.split(line, sep, -1))


def _raw_rows(lines: DataFrame, seps: list[str]) -> DataFrame:
    """(__path, __row, __role_hint, raw): each line's cells by the names of its layout's columns; overflowing cells join the last column. lines has names."""
    found = reduce(lambda out, sep: F.when(F.col("sep") == sep, cells(F.col("line"), sep)).otherwise(out), seps, F.lit(None).cast("array<string>"))
    rows = lines.select("path", "row_number", "role_hint", "names", found.alias("c"), F.size("names").alias("width"), F.regexp_like("line", F.lit('[^ ,;\\t"]')).alias("told"))
    more = F.filter(F.transform(F.slice("c", F.col("width"), F.greatest(F.size("c") - (F.col("width") - 1), F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    last = F.when(F.size("c") <= F.col("width"), F.trim(F.coalesce(F.get("c", F.col("width") - 1), F.lit("")))).otherwise(F.array_join(more, " "))
    blank = F.array_repeat(F.lit(""), F.greatest(F.col("width") - 1 - F.size("c"), F.lit(0)))
    rows = rows.select("path", "row_number", "role_hint", "names", "told", F.concat(F.slice("c", F.lit(1), F.col("width") - 1), blank, F.array(F.trim(last))).alias("values"))
    # A character other than blanks, separators and quotes stands in a cell; only other lines are looked at by cells.
    rows = rows.where(F.col("told") | F.exists("values", lambda x: F.trim(x) != ""))
    return rows.select(F.col("path").alias("__path"), F.col("row_number").alias("__row"), F.col("role_hint").alias("__role_hint"), F.map_from_arrays("names", "values").alias("raw"))


def _named_profile(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit("")
    for part, profile in reversed(NAME_HINTS):
        out = F.when(F.contains(name, F.lit(part)), profile).otherwise(out)
    return out


def parse(files: DataFrame) -> DataFrame:
    """Canonical rows of files (path, content), with path, row_number and role_hint; unreadable dates and amounts are null.

    Lines are written to the shared folder by kinds of layouts; each profile reads those of its layouts once, with all of these at a time.
    """
    lines = lines_of(files)
    found = lines.select("kind", "sep", "header", "named").distinct().limit(MAX_LAYOUTS + 1).collect()
    if len(found) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} layouts")
    layouts: dict[str, list[tuple]] = {}
    for kind, sep, header, named in found:
        names = list(profiles.TAB_HEADER)
        if header is not None:
            names = profiles.normalize_headers(next(csv.reader(header.splitlines(keepends=True), delimiter=sep)))
        profile = profiles.detect_profile(names)
        if profile.name == "generic" and named:
            profile = profiles.detect_profile(names, named)
        layouts.setdefault(profile.name, []).append((kind, sep, header, named, names))
    spark, parts = files.sparkSession, []
    for name, own in sorted(layouts.items()):
        known = [{"l_sep": sep, "l_header": header, "l_named": named, "names": names} for _, sep, header, named, names in own]
        known = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(known)), "array<struct<l_sep:string,l_header:string,l_named:string,names:array<string>>>"))))
        mine = lines.where(F.col("kind").isin(sorted({x[0] for x in own})))
        mine = mine.join(known, (F.col("sep") == F.col("l_sep")) & F.col("header").eqNullSafe(F.col("l_header")) & (F.col("named") == F.col("l_named")))
        parts.append(profiles.canonical_maps(_raw_rows(mine, sorted({x[1] for x in own})), profiles.detect_profile([], name), {c for x in own for c in x[4]}))
    if not parts:
        empty = spark.createDataFrame([], "__path string, __row int, __role_hint string, raw map<string,string>")
        parts = [profiles.canonical_maps(empty, profiles.PROFILES[-1], set())]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"__path": "path", "__row": "row_number", "__role_hint": "role_hint"})


def in_euros(rows: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """Rows with `stored`, their amount in EUR: their own EUR side if they have one, else by the latest rate (rate_date, currency, eur_per_unit) at or before their day."""
    sign = F.when(F.col("amount") < 0, -1).otherwise(1)
    side = F.when(F.upper("source_currency") == "EUR", F.abs("source_amount")).when(F.upper("target_currency") == "EUR", F.abs("target_amount"))
    if rates is None:
        rows = rows.withColumn("eur_per_unit", F.lit(None).cast("double"))
    else:
        home = F.upper(F.coalesce("currency", F.lit(""))) == "EUR"  # these need no rate
        foreign = asof(rows.where(~home), rates, "currency", "txn_date", "rate_date", "eur_per_unit", "eur_per_unit")
        rows = foreign.unionByName(rows.where(home).withColumn("eur_per_unit", F.lit(None).cast(dict(rates.dtypes)["eur_per_unit"])))
    by_rate = (F.abs("amount").cast("double") * F.col("eur_per_unit")).cast(MONEY)
    stored = F.when(F.upper("currency") == "EUR", F.col("amount")).otherwise((sign * F.coalesce(side, by_rate)).cast(MONEY))
    return rows.withColumn("stored", stored.cast(MONEY)).drop("eur_per_unit")


def import_files(files: DataFrame, imported: DataFrame | None = None, accounts: DataFrame | None = None, transactions: DataFrame | None = None, rates: DataFrame | None = None) -> Imported:
    """What a batch of files (path, content) adds to what was imported before.

    A file fails if a row it keeps has no readable date or amount, or no rate for its currency; the error names the first such row. A row
    is a duplicate if an earlier file of the batch, or an earlier batch, has one of its fingerprint; repeats inside one file are none. An account's
    role changes only where it was unknown.
    """
    contents, states = file_states(files, imported)
    pending = contents.join(states.where("status = 'pending'"), ["path", "file_hash"], "left_semi").select("path", "content")
    with short_methods(files.sparkSession):
        rows = parse(pending) if rates is None else cut(parse(pending))  # rates are looked up in rows that are read twice
    rows = in_euros(rows, rates)
    wrong = F.when(F.col("txn_date").isNull(), "no readable date").when(F.col("amount").isNull(), "no readable amount").when(F.col("stored").isNull(), F.concat(F.lit("no rate for "), F.col("currency")))
    account = F.coalesce(F.nullif(F.trim("account"), F.lit("")), F.concat(F.col("institution"), F.lit(":unknown")))
    account_id = F.sha2(F.concat_ws("|", "institution", account), 256)
    other = F.when(F.col("counterparty_account") != account, F.sha2("counterparty_account", 256))
    merchant = F.coalesce(F.nullif(t.normalize_merchant(F.col("counterparty_name")), F.lit("")), t.normalize_merchant(F.col("description")))
    made = rows.select(
        "path", "row_number", wrong.alias("wrong"), "institution", account_id.alias("account_id"), account.alias("account_name"), "txn_date", "booking_date", F.col("stored").alias("amount"), F.lit("EUR").alias("currency"), F.when(F.col("stored") >= 0, "inflow").otherwise("outflow").alias("direction"),
        "counterparty_name", other.alias("counterparty_account_hash"), "description", merchant.alias("merchant"), "reference",
        F.unhex(t.fingerprint(account_id, F.col("txn_date"), F.col("stored"), F.lit("EUR"), F.col("counterparty_name"), F.col("description"), F.col("reference"))).alias("fingerprint"),
        "role_hint", F.upper(F.coalesce("native_currency", "currency")).alias("native_currency"), F.coalesce("native_amount", "amount").alias("native_amount"), "source_amount", F.upper("source_currency").alias("source_currency"),
        "target_amount", F.upper("target_currency").alias("target_currency"), "exchange_rate", "opening_balance", "closing_balance", "resulting_balance", "raw",
    )
    with short_methods(files.sparkSession):
        made = cut(made)
    per_file = cut(made.groupBy("path").agg(F.count("*").alias("n_rows"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("row_number", F.col("wrong").alias("why")))).alias("bad")))
    error = F.when(F.col("bad").isNotNull(), F.substring(F.concat(F.lit("row "), F.col("bad.row_number"), F.lit(": "), F.col("bad.why")), 1, MAX_ERROR))
    listed = states.join(per_file, "path", "left").withColumn("error", error)
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("error").isNotNull(), "failed").otherwise("imported")
    listed = listed.select("path", "file_hash", status.alias("status"), "role_hint", F.when(status == "imported", F.coalesce("n_rows", F.lit(0))).alias("n_rows"), "error")
    # Written, so that its size is known and a few failed files are broadcast.
    made = made.join(cut(per_file.where("bad is not null").select("path")), "path", "left_anti").drop("wrong")

    details = made.where((F.col("native_currency") != F.col("currency")) | (F.coalesce("source_currency", F.lit("")) != "") & (F.col("source_currency") != F.col("currency")))
    details = details.select("path", "row_number", "native_amount", "native_currency", "source_amount", "source_currency", "target_amount", "target_currency", "exchange_rate", F.col("amount").alias("converted_amount"))
    kinds = ["opening_balance", "closing_balance", "resulting_balance"]
    balances = made.unpivot(["path", "row_number", "account_id", "txn_date"], kinds, "balance_type", "balance").where("balance is not null")
    kept = made.drop(*kinds, "native_amount", "source_amount", "source_currency", "target_amount", "target_currency", "exchange_rate")
    return Imported(listed, with_duplicates(kept, transactions), details, balances, merge_accounts(made, accounts))


def with_duplicates(rows: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """Rows with is_duplicate and duplicate_of, and their fingerprint as text; nothing is read before the result is.

    Rows travel once, to what their fingerprint has in several files or earlier batches; that is found by fingerprints alone. No other
    result of an import has a part in it.
    """
    firsts = rows.groupBy("fingerprint").agg(F.min(F.struct("path", "row_number")).alias("first"), F.max("path").alias("last_path"))
    if transactions is None:
        firsts = firsts.withColumn("known", F.lit(False))
    else:
        seen = transactions.where("not is_duplicate").select(F.unhex("fingerprint").alias("fingerprint"), F.lit(True).alias("known")).distinct()
        firsts = firsts.join(seen, "fingerprint", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    several = firsts.where(F.col("known") | (F.col("last_path") > F.col("first.path"))).drop("last_path")
    known, later = F.coalesce("known", F.lit(False)), F.coalesce(F.col("path") > F.col("first.path"), F.lit(False))
    rows = rows.join(several, "fingerprint", "left").withColumn("is_duplicate", known | later)
    rows = rows.withColumns({"duplicate_of": F.when(F.col("is_duplicate") & ~known, F.col("first")), "fingerprint": F.lower(F.hex("fingerprint"))})
    return rows.drop("first", "known")


def merge_accounts(rows: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """(account_id, institution, account_name, role): accounts seen before keep their role unless it was unknown; new ones take the folder's, else the profile's."""
    roles = F.create_map(*[F.lit(x) for kv in PROFILE_ROLES.items() for x in kv])
    new = rows.groupBy("account_id").agg(F.min("institution").alias("institution"), F.min("account_name").alias("account_name"), F.min_by("role_hint", F.when(F.col("role_hint").isNotNull(), F.struct("path", "row_number"))).alias("hint"))
    if accounts is None:
        return new.select("account_id", "institution", "account_name", F.coalesce("hint", F.try_element_at(roles, F.col("institution")), F.lit("unknown")).alias("role"))
    old = accounts.select("account_id", *[F.col(c).alias(f"old_{c}") for c in ("institution", "account_name", "role")])
    both = new.join(old, "account_id", "full_outer")
    told = F.when(F.col("old_role").isin("unknown", ""), F.coalesce("hint", "old_role")).otherwise(F.col("old_role"))
    fresh = F.coalesce("hint", F.try_element_at(roles, F.col("institution")), F.lit("unknown"))
    return both.select("account_id", F.coalesce("old_institution", "institution").alias("institution"), F.coalesce("old_account_name", "account_name").alias("account_name"), F.when(F.col("old_role").isNotNull(), told).otherwise(fresh).alias("role"))


def write_snapshots(snapshots: DataFrame, folder: str) -> None:
    """A full rebuild of the monthly snapshots, stamped with its time."""
    snapshots.withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/monthly_snapshots")


def snapshots_current(snapshots: DataFrame, annotations: DataFrame) -> bool:
    """Whether snapshots (built_at) exist and none of the annotations (updated_at) is later."""
    built = snapshots.agg(F.min("built_at").alias("at")).first()["at"]
    latest = annotations.agg(F.max("updated_at").alias("at")).first()["at"]
    return built is not None and (latest is None or latest <= built)


def as_json(frame: DataFrame) -> DataFrame:
    """A column `json` with each row as an object, nulls included."""
    return frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("json"))
