"""Detectors over a ledger: salaries, recurring debits, trips, duplicates, the expected calendar, rules and the classification cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


#: Ranges of values are some 1 / RANGES wide, relative to the value; a group has a few thousand of them.
RANGES = 256


def value_range(value: Column) -> Column:
    """A number that never falls where the value rises: ranges of values of about the same relative width."""
    x = value.cast("double")
    return (F.signum(x) * F.floor(F.log1p(F.abs(x)) * RANGES)).cast("long")


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Element n // 2 (from 0) of each group's ascending values.

    Values are counted first, so equal ones are one row before any shuffle. Counts are summed by ranges of values; the range that holds the element is found over a group's
    ranges, of which there are few, and only the values of that one range are ordered: no task orders a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).withColumn("range", value_range(F.col(value)))
    ranges = counts.groupBy(*by, "range").agg(F.sum("n").alias("n_range"))
    over = Window.partitionBy(*by)
    summed = ranges.withColumns({"upto": F.sum("n_range").over(over.orderBy("range")), "at": F.floor(F.sum("n_range").over(over) / 2)})
    chosen = summed.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n_range") <= F.col("at"))).select(*by, "range", (F.col("at") - F.col("upto") + F.col("n_range")).alias("at"))
    inside = counts.join(chosen, [*by, "range"]).withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "range").orderBy(value)))
    return inside.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select(*by, F.col(value).cast(MONEY).alias(name))


def salary_groups(ledger: DataFrame, by: list[str], least_months: int = 2) -> DataFrame:
    """Inflows by source: months, upper median of the amounts."""
    rows = ledger.where("amount > 0")
    groups = rows.groupBy(*by).agg(F.countDistinct(F.date_format("txn_date", "yyyy-MM")).alias("n_months"), F.count("*").alias("n")).where(F.col("n_months") >= least_months)
    return groups.join(upper_medians(rows, by, "amount"), by)


def salaries(ledger: DataFrame, by: list[str], minimum: float = 1500.0, least: float = 250.0, share: float = 0.12) -> DataFrame:
    """Rows near their source's median. Groups are summed first, then joined back: the ledger is shuffled once by source."""
    rows = ledger.where(F.col("amount") >= minimum)
    groups = salary_groups(rows, by)
    near = F.abs(F.col("amount") - F.col("median")) <= F.greatest(F.lit(least), F.col("median") * share)
    return rows.join(groups.select(*by, "median"), by).where(near)


def pay_window(date: Column) -> Column:
    """Whether a salary may come in on a date: around the 25th, wider in December."""
    day, month = F.dayofmonth(date), F.month(date)
    weekday = F.weekday(F.make_date(F.year(date), month, F.lit(25)))  # 5 is a Saturday
    first = F.when(month == 12, 18).when(weekday == 6, 25).otherwise(24)
    last = F.when(month == 12, 26).when(weekday == 5, 25).otherwise(26)
    return (day >= first) & (day <= last)


def recurring_debits(ledger: DataFrame, by: list[str], bucket: float = 10.0, occurrences: int = 6, deviation_limit: float = 0.02, gap: tuple[int, int] = (20, 45), least_gaps: int = 4) -> DataFrame:
    """Groups of outflows of one counterparty and amount bucket that come at regular gaps and hardly vary."""
    size = F.abs("amount")
    rows = ledger.where("amount < 0").select(*by, "txn_date", "id", size.cast(MONEY).alias("size"), (F.bround(size.cast("double") / bucket) * bucket).cast("long").alias("bucket"))
    keys = [*by, "bucket"]
    sizes = rows.groupBy(*keys, "size").agg(F.count("*").alias("k"))
    totals = sizes.groupBy(*keys).agg(F.sum(F.col("size") * F.col("k")).cast(MONEY).alias("total"), F.sum("k").alias("n"))
    deviation = F.abs(F.col("size") * F.col("n").cast("decimal(9,0)") - F.col("total"))
    off = sizes.join(totals, keys).groupBy(*keys).agg((F.sum(deviation * F.col("k").cast("decimal(9,0)"))).cast("double").alias("off"))
    # Rows of a day come no days after each other, so a group's days are ordered, not its rows.
    days = rows.groupBy(*keys, "txn_date").agg(F.count("*").alias("k")).withColumn("days", F.datediff("txn_date", F.lag("txn_date").over(Window.partitionBy(*keys).orderBy("txn_date"))))
    same_day = F.sum(F.col("k") - 1) if gap[0] <= 0 <= gap[1] else F.lit(0)
    gaps = days.groupBy(*keys).agg((F.count_if(F.col("days").between(*gap)) + same_day).alias("n_regular"))
    n = F.col("n")
    groups = totals.join(off, keys).join(gaps, keys).select(*keys, "n", (F.col("total").cast("double") / n).alias("mean"), (F.col("off") / (n * n)).alias("mad"), "n_regular")
    return groups.where((F.col("n") >= occurrences) & (F.col("mad") <= F.col("mean") * deviation_limit) & (F.col("n_regular") >= F.greatest(F.lit(least_gaps), F.col("n") - 2)))


def trip_islands(ledger: DataFrame, by: list[str], gap: int = 5, seeds: int = 3) -> DataFrame:
    """Runs of outflows with no gap of more than so many days: first and last day, rows, sum; runs of few rows are none."""
    rows = ledger.where("amount < 0")
    w = Window.partitionBy(*by).orderBy("txn_date", "id")
    new = F.coalesce((F.datediff("txn_date", F.lag("txn_date").over(w)) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("__new", new).withColumn("trip", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    trips = numbered.groupBy(*by, "trip").agg(F.min("txn_date").alias("first_day"), F.max("txn_date").alias("last_day"), F.count("*").alias("n"), F.sum("amount").cast("decimal(28,2)").alias("total"))
    return trips.where(F.col("n") >= seeds)


def trip_members(ledger: DataFrame, trips: DataFrame, pad: int = 3) -> DataFrame:
    """Each outflow with the first trip (by country, then first day) whose padded days hold it; trips are few and broadcast by size."""
    days = trips.select("country", "first_day", F.explode(F.sequence(F.date_sub("first_day", pad), F.date_add("last_day", pad))).alias("day"))
    first = days.groupBy("day").agg(F.min(F.struct("country", "first_day")).alias("trip"))
    met = ledger.where("amount < 0").join(first, F.col("txn_date") == F.col("day"))
    return met.select("id", "txn_date", F.col("trip.country").alias("country"), F.concat_ws(" ", F.col("trip.country"), F.year("trip.first_day")).alias("label"))


def duplicate_flags(rows: DataFrame, fingerprint: str = "fingerprint", file: str = "file_seq") -> DataFrame:
    """Marks rows whose fingerprint stands in an earlier file; repeats in one file are none."""
    firsts = rows.groupBy(fingerprint).agg(F.min(file).alias("__first"))
    return rows.join(firsts, fingerprint).withColumn("is_duplicate", F.col(file) > F.col("__first")).drop("__first")


def expected_calendar(income: DataFrame, by: list[str], closing_day: int = 28, least: float = 750.0, share: float = 0.18) -> DataFrame:
    """Each source's months from its first to the last closed one with what was expected (the upper median of months) and what came.

    The last month is closed if the ledger reaches its `closing_day`. satisfied: came + tolerance >= expected.
    """
    months = income.where("amount > 0").groupBy(*by, F.trunc("txn_date", "month").alias("month")).agg(F.sum("amount").cast(MONEY).alias("observed"))
    latest = income.agg(F.max("txn_date").alias("latest"))
    last = F.when(F.dayofmonth("latest") >= closing_day, F.trunc("latest", "month")).otherwise(F.add_months(F.trunc("latest", "month"), -1))
    groups = months.groupBy(*by).agg(F.min("month").alias("first"), F.count("*").alias("n")).where("n >= 2").join(upper_medians(months, by, "observed", "expected"), by)
    spine = groups.crossJoin(F.broadcast(latest.select(last.alias("last")))).where("first <= last").select(*by, "expected", F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))
    met = spine.join(months, [*by, "month"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast(MONEY))
    tolerance = F.greatest(F.lit(least).cast(MONEY), (F.col("expected") * F.lit(share).cast("decimal(6,4)")).cast(MONEY)).cast(MONEY)
    return met.select(*by, F.date_format("month", "yyyy-MM").alias("month"), "expected", "observed", tolerance.alias("tolerance"), (F.col("observed") + tolerance >= F.col("expected")).alias("satisfied"))


#: What a rule may ask for; absent conditions are null. A rule must name one narrow enough scope, or it matches nothing.
RULE_SCHEMA = "rule_id long, priority int, transaction_id long, account_id long, merchant_contains string, direction string, abs_amount double, amount_tolerance double, min_abs_amount double, months array<int>, economic_class string, category string, confidence double"


def safe_rules(rules: DataFrame) -> DataFrame:
    """Rules that name a transaction, an account, or at least four characters of a merchant with a letter among them."""
    merchant = F.upper(F.trim(F.coalesce("merchant_contains", F.lit(""))))
    named = (F.length(merchant) >= 4) & F.regexp_like(merchant, F.lit("[A-Z]"))
    return rules.where(F.col("transaction_id").isNotNull() | F.col("account_id").isNotNull() | named)


def match_rules(ledger: DataFrame, rules: DataFrame, max_rules: int = 100_000) -> DataFrame:
    """Each row with the first rule (priority, id) that it meets in full; rows no rule meets are left out.

    Rules are a user's own and few; the table is broadcast only if it has no more than max_rules rows. Rules by transaction or account are
    equi joins; the others meet the distinct merchants, not the rows.
    """
    rules = safe_rules(rules)
    few = rules.limit(max_rules + 1).count() <= max_rules
    side = F.broadcast(rules) if few else rules
    sign = F.when(F.col("amount") < 0, "out").otherwise("in")
    size = F.abs("amount").cast("double")

    def rest(r: str) -> Column:
        c = lambda name: F.col(f"{r}.{name}")
        free = lambda name, test: c(name).isNull() | test
        return (
            free("transaction_id", c("transaction_id") == F.col("id"))
            & free("account_id", c("account_id") == F.col("t.account_id"))
            & free("merchant_contains", F.contains(F.upper("merchant"), F.upper(c("merchant_contains"))))
            & free("direction", c("direction") == sign)
            & free("abs_amount", F.abs(size - c("abs_amount")) <= F.coalesce(c("amount_tolerance"), F.lit(0.01)))
            & free("min_abs_amount", size >= c("min_abs_amount"))
            & free("months", F.array_contains(c("months"), F.month("txn_date")))
        )

    t = ledger.alias("t")
    by_row = t.join(side.where("transaction_id is not null").alias("r"), F.col("t.id") == F.col("r.transaction_id")).where(rest("r"))
    by_account = t.join(side.where("transaction_id is null and account_id is not null").alias("r"), F.col("t.account_id") == F.col("r.account_id")).where(rest("r"))
    merchants = ledger.select(F.col("merchant").alias("m")).distinct()
    named = rules.where("transaction_id is null and account_id is null")
    met = merchants.join(F.broadcast(named) if few else named, F.contains(F.upper("m"), F.upper("merchant_contains")))
    by_merchant = t.join(met.alias("r"), F.col("t.merchant") == F.col("r.m")).where(rest("r"))
    chosen = lambda x: x.select("id", F.struct(F.col("r.priority").alias("priority"), F.col("r.rule_id").alias("rule_id"), F.col("r.economic_class").alias("economic_class"), F.col("r.category").alias("category"), F.col("r.confidence").alias("confidence")).alias("rule"))
    best = chosen(by_row).union(chosen(by_account)).union(chosen(by_merchant)).groupBy("id").agg(F.min("rule").alias("rule"))
    return best.select("id", "rule.rule_id", "rule.economic_class", "rule.category", "rule.confidence")


def rule_audit(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows and value that each rule decides; rules that decide none have zeros."""
    met = match_rules(ledger, rules).select("id", "rule_id").join(ledger.select("id", F.abs("amount").alias("size")), "id")
    sums = met.groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("size").cast("decimal(28,2)").alias("value"))
    return rules.select("rule_id").join(sums, "rule_id", "left").select("rule_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0)).cast("decimal(28,2)").alias("value"))


def digest_tier(economic_class: Column, category: Column, confidence: Column, reviewed: Column | None = None) -> Column:
    out = F.when(economic_class == "needs_review", "review").when(confidence < 0.70, F.when(category == "Uncategorized", "review").otherwise("auto_visible")).when(confidence >= 0.90, "auto_silent").otherwise("auto_visible")
    return out if reviewed is None else F.when(reviewed, "reviewed").otherwise(out)


def classify(ledger: DataFrame, predicates: list[tuple[str, Column, str, str, float]], review_amount: float = 250.0, credit_amount: float = 500.0) -> DataFrame:
    """First match of an ordered cascade: (name, predicate, class, category, confidence); then what is left by sign and size.

    Predicates are boolean columns first, so that each is computed once and the chain is over booleans.
    """
    flags = {f"__p{i}": F.coalesce(p[1], F.lit(False)) for i, p in enumerate(predicates)}
    rows = ledger.withColumns(flags)
    verdict = lambda name, cls, cat, conf: F.struct(F.lit(name).alias("rule"), F.lit(cls).alias("economic_class"), F.lit(cat).alias("category"), F.lit(conf).cast("double").alias("confidence"))
    chain = None
    for i, (name, _, cls, cat, conf) in enumerate(predicates):
        chain = F.when(F.col(f"__p{i}"), verdict(name, cls, cat, conf)) if chain is None else chain.when(F.col(f"__p{i}"), verdict(name, cls, cat, conf))
    size = F.abs("amount")
    tail = [
        ((F.col("amount") > 0) & (size < credit_amount), verdict("small credit", "refund", "Other", 0.55)),
        (F.col("amount") > 0, verdict("large credit", "needs_review", "Uncategorized", 0.45)),
        (size >= review_amount, verdict("material unknown", "needs_review", "Uncategorized", 0.40)),
    ]
    for test, out in tail:
        chain = F.when(test, out) if chain is None else chain.when(test, out)
    rows = rows.withColumn("__v", chain.otherwise(verdict("other", "household_spend", "Other", 0.50))).drop(*flags)
    v = F.col("__v")
    return rows.select("id", v["rule"].alias("rule"), v["economic_class"].alias("economic_class"), v["category"].alias("category"), v["confidence"].alias("confidence"), digest_tier(v["economic_class"], v["category"], v["confidence"]).alias("digest_tier"))


def escalate(annotations: DataFrame, amount: float = 500.0) -> DataFrame:
    """Large one-off inflows go to review with a confidence of 0.69 at most; annotations has amount, economic_class, confidence, digest_tier."""
    large = (F.col("amount") >= amount) & F.col("economic_class").isin("income", "needs_review")
    return annotations.withColumns({"digest_tier": F.when(large, "review").otherwise(F.col("digest_tier")), "confidence": F.when(large, F.least("confidence", F.lit(0.69))).otherwise(F.col("confidence"))})


def review_groups(ledger: DataFrame, by: list[str], top: int = 150) -> DataFrame:
    """What needs a decision, by group: rows, value, and the largest row as its representative; the most material groups."""
    size = F.abs("amount")
    wants = (F.col("economic_class") == "needs_review") | (F.col("confidence") < 0.55) | ((F.col("category") == "Uncategorized") & (size >= 100))
    groups = ledger.where(wants).groupBy(*by).agg(F.count("*").alias("n"), F.sum(size).cast("decimal(28,2)").alias("materiality"), F.max(F.struct(size.alias("size"), (-F.col("id")).alias("order"))).alias("top"))
    out = groups.select(*by, "n", "materiality", (-F.col("top.order")).alias("transaction_id"))
    return out.orderBy(F.desc("materiality"), *by).limit(top)


def merge_keyed(existing: DataFrame, new: DataFrame, keys: list[str], keep: str = "new") -> DataFrame:
    """Rows of both by key; of rows with one key those of `keep` ("new" replaces, "existing" ignores)."""
    first, second = (new, existing) if keep == "new" else (existing, new)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").select(*first.columns))


def rule_scope(counterparty: str | None, merchant: str | None, recurring: bool, merchant_scope: bool = True) -> str:
    """The narrowest safe scope of a rule made from one reviewed row."""
    if counterparty:
        return "recurring_debit" if recurring else "counterparty"
    letters = sum(x.isalpha() for x in merchant or "")
    if merchant_scope and merchant and len(merchant.strip()) >= 4 and letters:
        return "merchant"
    return "transaction"
