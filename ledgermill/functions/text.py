"""Column functions for transaction text: merchant normaliser and categoriser, amounts and dates in many styles, account numbers, fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our rewrites of a merchant's name, applied in order to its upper-case form.
MERCHANT_REWRITES = (
    (r"^(PAYPAL|SQ|SUMUP|ZETTLE|STRIPE)\s*\*\s*", ""),
    (r"\b(CARD|PAS|TERM|TRANSACTION|REF)[ :#]*[0-9A-Z]{4,}\b", " "),
    (r"\b\d{1,2}[-/.]\d{1,2}([-/.]\d{2,4})?\b", " "),
    (r"\b\d{1,2}:\d{2}\b", " "),
    (r"#\d+", " "),
    (r"\b\d{4,}\b", " "),
    (r"[^A-Z0-9&' .+-]", " "),
    (r"\s+", " "),
)
MERCHANT_LENGTH = 120
#: Our own keyword groups, in order; the first that a text holds names the category.
KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Groceries", ("SUPERMARKET", "GROCER", "BAKERY", "MARKET")),
    ("Transportation", ("RAILWAY", "METRO", "FUEL", "PARKING", "TAXI")),
    ("Utilities", ("ELECTRIC", "WATER", "GAS ", "INTERNET", "TELECOM")),
    ("Home and Furniture", ("FURNITURE", "HARDWARE", "GARDEN")),
    ("Health", ("PHARMACY", "DENTIST", "CLINIC", "HOSPITAL")),
    ("Holiday", ("HOTEL", "AIRLINE", "CAMPING")),
    ("Dining", ("RESTAURANT", "CAFE", "COFFEE", "PIZZA")),
    ("Insurance", ("INSURANCE", "INSURER")),
    ("Education", ("SCHOOL", "UNIVERSITY", "BOOKSHOP")),
)
KEYWORD_CONFIDENCE = 0.82
#: Date patterns, tried in order on the first ten characters.
DATE_PATTERNS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "yyyyMMdd", "ddMMyyyy", "yyyy/M/d", "d.M.yyyy")
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Words of a flag column that make an amount an outflow.
DEBIT_WORDS = ("af", "debit", "d", "uit", "withdrawal")


def clean(x: Column) -> Column:
    """Upper case with single spaces; a null is an empty text."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"\s+", " "))


def normalize_merchant(name: Column) -> Column:
    out = F.upper(F.coalesce(name, F.lit("")))
    for pattern, put in MERCHANT_REWRITES:
        out = F.regexp_replace(out, pattern, put)
    return F.substring(F.trim(out), 1, MERCHANT_LENGTH)


def categorize(text: Column, keywords: tuple[tuple[str, tuple[str, ...]], ...] = KEYWORDS) -> Column:
    """The first group with a keyword in the text; null if none has."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = None
    for name, words in keywords:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(upper, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def contains_word(text: Column, word: str) -> Column:
    """Words of three characters and fewer must stand alone; longer ones may be part of another."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    if len(word) > 3:
        return F.contains(upper, F.lit(word.upper()))
    return F.regexp_like(upper, F.lit(rf"(^|[^A-Z0-9]){word.upper()}([^A-Z0-9]|$)"))


def parse_amount(text: Column, flag: Column | None = None) -> Column:
    """decimal(18,2) of an amount with either separator: the last of comma and dot is decimal if both stand, a lone comma is decimal.

    flag is a debit or credit word; a debit makes the amount negative. What isn't a number is null.
    """
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9,.+-]", "")
    minus = F.regexp_like(raw, F.lit("^-|-$"))
    if flag is not None:
        minus = F.lower(F.trim(F.coalesce(flag, F.lit("")))).isin(*DEBIT_WORDS) | minus
    # The last separator is a comma: that is decimal. Few copies of the text, as each is computed.
    number = F.when(F.regexp_like(raw, F.lit(",[^.]*$")), F.translate(raw, ",.+-", ".")).otherwise(F.translate(raw, ",+-", ""))
    return F.concat(F.when(minus, "-").otherwise(""), F.nullif(number, F.lit(""))).try_cast("decimal(18,2)")


def date_shape(pattern: str) -> str:
    """What each text that a date pattern reads looks like: digits, at least four for a year, and the pattern's separators."""
    parts = re.findall(r"(y+|M+|d+)|(.)", pattern)
    if not any(sep for _, sep in parts):
        return r"^[+-]?[0-9]+$"
    return "^" + "".join(re.escape(sep) if sep else r"[+-]?[0-9]{4,}" if "y" in run else r"[+-]?[0-9]+" for run, sep in parts) + "$"


def parse_date(text: Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """The date by the first pattern that fits; null if none does. Texts of another shape aren't tried, as each failure is an exception inside."""
    head = F.substring(F.trim(text), 1, 10)
    return F.coalesce(*[F.when(F.regexp_like(head, F.lit(date_shape(p))), F.try_to_date(head, p)) for p in patterns])


def month_day(text: Column, year: Column, last_month: Column | None = None) -> Column:
    """A date from day-month and a statement's year; months after the statement's last month are of the year before."""
    parts = F.split(F.trim(text), "-")
    m, d = F.get(parts, 1).try_cast("int"), F.get(parts, 0).try_cast("int")
    own = year if last_month is None else F.when(m > last_month, year - 1).otherwise(year)
    return F.try_to_date(F.format_string("%d-%d-%d", own.cast("int"), m, d), "yyyy-M-d")


def iban_pattern() -> str:
    """Account numbers of exactly the length of their country, with single spaces or hyphens anywhere in them."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    forms = "|".join(f"(?:{'|'.join(countries)})[ -]?[0-9][ -]?[0-9](?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, countries in sorted(by_length.items()))
    return rf"(?<![A-Z0-9])(?:{forms})(?![A-Z0-9])"


def extract_ibans(text: Column, own: Column | None = None) -> Column:
    """Account numbers of the right length for their country, in order, each once, without separators and one's own."""
    found = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(iban_pattern()), F.lit(0))
    squeeze = lambda x: F.regexp_replace(x, "[ -]", "")
    out = F.array_distinct(F.transform(found, squeeze))
    return out if own is None else F.filter(out, lambda x: x != squeeze(F.upper(F.coalesce(own, F.lit("")))))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the upper-case, trimmed parts."""
    return F.sha2(F.concat_ws("|", *[F.upper(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]), 256)


def fixed_merchant_pattern(names: tuple[str, ...]) -> str:
    """One pattern for all names; short ones must stand alone."""
    return "|".join(rf"(^|[^A-Z0-9]){n.upper()}([^A-Z0-9]|$)" if len(n) <= 3 else n.upper() for n in names)


def first_value(columns: list[str], *names: str) -> Column:
    """The first non-empty of those names that the columns have; null if none."""
    have = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")
