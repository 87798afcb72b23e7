"""Questions about a ledger: spending by category and merchant, trends, recurring merchants, shifts between years, data health, audits.

All are one or two groupings with partial sums before the shuffle; rankings are windows over aggregates, so no window sees a ledger's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshots import BURN_CLASSES, MONEY, active, month

UNCATEGORIZED = "Uncategorized"
#: Confidence below the first bound is low, below the second medium.
BANDS = (0.65, 0.85)
DEFAULT_CONTROLLABILITY = 0.5


def out_of(amount: str = "amount") -> Column:
    return F.when(F.col(amount) < 0, -F.col(amount)).otherwise(F.lit(0)).cast(MONEY)


def in_of(amount: str = "amount") -> Column:
    return F.when(F.col(amount) > 0, F.col(amount)).otherwise(F.lit(0)).cast(MONEY)


def category() -> Column:
    return F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(UNCATEGORIZED))


def burn(ledger: DataFrame) -> DataFrame:
    """Active outflows of the burn classes."""
    return active(ledger).where(F.col("economic_class").isin(*BURN_CLASSES) & (F.col("amount") < 0))


def confidence_band(x: Column) -> Column:
    return F.when(x < BANDS[0], "low").when(x < BANDS[1], "medium").otherwise("high")


def spending_breakdown(ledger: DataFrame) -> DataFrame:
    """Outflow, inflow, count and mean confidence by class, category and subcategory."""
    return active(ledger).groupBy("economic_class", category().alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory")).agg(
        F.sum(out_of()).cast(MONEY).alias("outflow"), F.sum(in_of()).cast(MONEY).alias("inflow"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


def category_month(ledger: DataFrame) -> DataFrame:
    return burn(ledger).groupBy(month(), category().alias("category")).agg(F.sum(out_of()).cast(MONEY).alias("outflow"))


def merchant_category_month(ledger: DataFrame) -> DataFrame:
    return burn(ledger).groupBy("merchant", category().alias("category"), month()).agg(F.sum(out_of()).cast(MONEY).alias("outflow"), F.count("*").alias("n"))


def category_year(ledger: DataFrame) -> DataFrame:
    return burn(ledger).groupBy(F.year("txn_date").alias("year"), category().alias("category")).agg(F.sum(out_of()).cast(MONEY).alias("outflow"))


def spend_months(ledger: DataFrame) -> DataFrame:
    """How many months of each year have burn."""
    return burn(ledger).groupBy(F.year("txn_date").alias("year")).agg(F.countDistinct(F.month("txn_date")).alias("n_months"))


def year_totals(ledger: DataFrame) -> DataFrame:
    rows = active(ledger)
    cls = F.col("economic_class")
    return rows.groupBy(F.year("txn_date").alias("year")).agg(
        F.sum(F.when(cls.isin(*BURN_CLASSES), out_of()).otherwise(0)).cast(MONEY).alias("spend"), F.sum(F.when(cls == "income", in_of()).otherwise(0)).cast(MONEY).alias("income")
    )


def fixed_variable_split(ledger: DataFrame, fixed: tuple[str, ...], quasi_fixed: tuple[str, ...] = (), fixed_merchants: str | None = None) -> DataFrame:
    """Burn of each month by fixed, quasi-fixed and variable: by category, or by a pattern on the merchant."""
    is_fixed = F.col("category").isin(*fixed) | (F.col("economic_class") == "debt_service")
    if fixed_merchants:
        is_fixed |= F.regexp_like(F.upper("merchant"), F.lit(fixed_merchants))
    is_quasi = F.col("category").isin(*quasi_fixed)
    kind = F.when(is_fixed, "fixed").when(is_quasi, "quasi").otherwise("variable")
    part = lambda k: F.sum(F.when(F.col("kind") == k, out_of()).otherwise(0)).cast(MONEY).alias(k)
    return burn(ledger).withColumn("kind", kind).groupBy(month()).agg(part("fixed"), part("quasi"), part("variable"))


def fixed_variable_averages(split: DataFrame) -> DataFrame:
    """Over the months that have burn, not over those of a period."""
    return split.agg(F.count("*").alias("n_months"), *[F.round(F.avg(F.col(c).cast("double")), 4).alias(f"avg_{c}") for c in ("fixed", "quasi", "variable")])


def data_health(ledger: DataFrame) -> DataFrame:
    """One row of counters over the whole ledger, in one pass."""
    dup, cls, size = F.col("is_duplicate"), F.col("economic_class"), F.abs("amount")
    band = confidence_band(F.col("confidence"))
    part = lambda x, name: F.coalesce(F.sum(F.when(~dup & x, size)), F.lit(0)).cast(MONEY).alias(name)
    return ledger.agg(
        F.count_if(~dup).alias("transactions"),
        F.count_if(dup).alias("duplicates"),
        F.count("economic_class").alias("annotated"),
        part(cls == "needs_review", "needs_review_value"),
        part((cls == "reimbursement_pass_through") & (F.col("amount") > 0), "reimbursements_received"),
        *[part(band == b, f"value_{b}") for b in ("low", "medium", "high")],
    )


def linked_per_outflow(links: DataFrame) -> DataFrame:
    return links.groupBy("outflow_id").agg(F.sum("amount").cast(MONEY).alias("linked"), F.array_join(F.sort_array(F.collect_list("inflow_id")), ",").alias("inflow_ids"))


def bucket_totals(ledger: DataFrame, links: DataFrame, by: Column | None = None) -> DataFrame:
    """Burn net of linked reimbursements by month (or `by`), category and subcategory; links are summed before they meet the rows, so none fans out."""
    rows = burn(ledger).join(linked_per_outflow(links).withColumnRenamed("outflow_id", "id"), "id", "left")
    net = F.greatest(F.lit(0), -F.col("amount") - F.coalesce("linked", F.lit(0)))
    return rows.groupBy(month() if by is None else by, category().alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory")).agg(
        F.sum(-F.col("amount")).cast(MONEY).alias("gross"), F.sum(net).cast(MONEY).alias("net"), F.count("*").alias("n")
    )


#: The categories of a bucket that isn't one category of its own name.
BUCKETS = {
    "Subscriptions": ("Subscriptions", "Banking and Fees", "ING monthly"),
    "Transportation": ("Transportation", "Gas"),
    "Home": ("Home and Furniture",),
    "Card spend": ("Unknown Card Spend",),
    "Transfers": ("Inter-account Transfers",),
    "Investments": ("Wealth Allocation", "Investments"),
}


def of_bucket(ledger: DataFrame, bucket: str) -> DataFrame:
    """The rows whose category, Uncategorized if null, is of the bucket; an empty name is every row."""
    return ledger.where(category().isin(*BUCKETS.get(bucket, (bucket,)))) if bucket else ledger


def bucket_top_merchants(ledger: DataFrame, n: int = 5) -> DataFrame:
    """The n merchants with most burn in each category; ties by name."""
    sums = burn(ledger).groupBy(category().alias("category"), "merchant").agg(F.sum(out_of()).cast(MONEY).alias("spend"))
    w = Window.partitionBy("category").orderBy(F.desc("spend"), "merchant")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recurring_merchants(ledger: DataFrame) -> DataFrame:
    """Merchants by how steadily money goes to them: months, mean, mean absolute deviation of the months, stability, cadence."""
    months = burn(ledger).groupBy("merchant", category().alias("category"), month()).agg(F.sum(out_of()).cast(MONEY).alias("spent"))
    w = Window.partitionBy("merchant", "category")
    marked = months.select("merchant", "category", F.col("spent").cast("decimal(18,2)").alias("spent"))
    marked = marked.withColumns({"total": F.sum("spent").over(w).cast("decimal(18,2)"), "n": F.count("*").over(w).cast("decimal(6,0)")})
    # Deviations are summed as decimals, n times as large, so the figures don't hang on the order of rows.
    deviation = F.abs(F.col("spent") * F.col("n") - F.col("total"))
    n = F.count("*")
    sums = marked.groupBy("merchant", "category").agg(
        n.alias("n_months"), F.max("total").cast(MONEY).alias("total"), (F.sum(deviation).cast("double") / (n * n)).alias("mad"), (F.max("total").cast("double") / n).alias("monthly_mean")
    )
    stability = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide("mad", "monthly_mean"), F.lit(0.0)))
    out = sums.where((F.col("n_months") >= 2) | (F.col("total") >= 500)).withColumn("stability", stability)
    cadence = F.when((F.col("n_months") >= 3) & (F.col("stability") >= 0.65), "monthly").otherwise("irregular")
    return out.select("merchant", "category", "n_months", "total", "monthly_mean", "mad", "stability", cadence.alias("cadence"), (F.col("monthly_mean") * 12).alias("annualized"))


def category_trends(ledger: DataFrame, floor: float = 75.0, change: float = 0.15, least_months: int = 4) -> DataFrame:
    """Categories whose mean of the last three months that are there differs from the three before; needs four months."""
    sums = category_month(ledger)
    months = sums.select("month").distinct()
    rank = months.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("month"))), "all": F.count("*").over(Window.partitionBy())})
    of = F.when(F.col("rank") <= 3, "recent").when(F.col("rank") <= 6, "prior")
    few = rank.where(F.col("all") >= least_months).where(F.col("rank") <= 6).withColumn("part", of)
    sizes = few.agg(F.count_if(F.col("part") == "recent").alias("n_recent"), F.count_if(F.col("part") == "prior").alias("n_prior"))
    met = sums.join(F.broadcast(few.select("month", "part")), "month")
    part = lambda k: F.coalesce(F.sum(F.when(F.col("part") == k, F.col("outflow"))), F.lit(0)).cast("double")
    sides = met.groupBy("category").agg(part("recent").alias("recent"), part("prior").alias("prior")).crossJoin(F.broadcast(sizes))
    recent, prior = F.col("recent") / F.col("n_recent"), F.col("prior") / F.col("n_prior")
    ratio = F.when(F.col("prior") > 0, (recent - prior) / prior).otherwise(1.0)
    out = sides.select("category", F.round(recent, 4).alias("recent_avg"), F.round(F.coalesce(prior, F.lit(0.0)), 4).alias("prior_avg"), F.round(ratio, 6).alias("change"))
    return out.where((F.col("recent_avg") >= floor) & (F.abs("change") >= change))


def optimization(ledger: DataFrame, controllability: dict[str, float], top: int = 8) -> DataFrame:
    """The categories where most could be saved: burn times how far a category is under control."""
    sums = burn(ledger).groupBy(category().alias("category")).agg(F.sum(out_of()).cast(MONEY).alias("outflow"))
    table = F.create_map(*[F.lit(x) for kv in controllability.items() for x in kv]) if controllability else None
    control = F.coalesce(F.try_element_at(table, F.col("category")), F.lit(DEFAULT_CONTROLLABILITY)) if table is not None else F.lit(DEFAULT_CONTROLLABILITY)
    share = F.col("outflow").cast("double") / F.sum(F.col("outflow").cast("double")).over(Window.partitionBy())
    reason = F.when(control >= 0.75, "highly controllable").when(control >= 0.45, "partly controllable").otherwise("hard to change")
    rows = sums.select("category", "outflow", control.alias("controllability"), F.round(share, 6).alias("share"), F.round(F.col("outflow").cast("double") * control, 4).alias("score"), reason.alias("reason"))
    return rows.orderBy(F.desc("score"), "category").limit(top)


def yoy_shifts(ledger: DataFrame, full_year: int = 12, floor: float = 100.0, change: float = 15.0, top: int = 5) -> DataFrame:
    """The largest shifts of categories between years that follow one another in the data and both have burn in twelve months."""
    years = spend_months(ledger).withColumn("next", F.lead("year").over(Window.orderBy("year")))
    full = years.where(F.col("n_months") >= full_year)
    pairs = full.select(F.col("year").alias("prior_year"), F.col("next").alias("year")).join(full.select("year"), "year")
    sums = category_year(ledger)
    of = lambda name: pairs.join(sums.select(F.col("year").alias("y"), "category", "outflow"), F.col(name) == F.col("y")).select("prior_year", "year", "category", F.col("outflow").alias(f"of_{name}"))
    both = of("prior_year").join(of("year"), ["prior_year", "year", "category"], "full_outer").na.fill(0)
    prior, now = F.col("of_prior_year").cast("double"), F.col("of_year").cast("double")
    rows = both.where(prior > floor).withColumn("pct", F.round((now - prior) / prior * 100, 4)).where(F.abs("pct") > change)
    rows = rows.select("prior_year", "year", "category", F.round(now - prior, 2).alias("delta"), "pct", F.format_string("%+.1f%%", "pct").alias("shown"))
    w = Window.partitionBy("year").orderBy(F.desc(F.abs("delta")), "category")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def jump_drivers(ledger: DataFrame, top: int = 3) -> DataFrame:
    """For each year after the first, its change of burn and the categories that drove it most."""
    sums = category_year(ledger)
    years = sums.select("year").distinct().withColumn("before", F.lag("year").over(Window.orderBy("year"))).where("before is not null")
    now = years.join(sums, "year").select("year", "before", "category", "outflow")
    then = years.join(sums.withColumnRenamed("year", "before"), "before").select("year", "before", "category", F.col("outflow").alias("prior"))
    both = now.join(then, ["year", "before", "category"], "full_outer").na.fill(0)
    delta = (F.col("outflow") - F.col("prior")).cast(MONEY)
    rows = both.withColumn("delta", delta).withColumn("year_delta", F.sum("delta").over(Window.partitionBy("year")).cast(MONEY))
    w = Window.partitionBy("year").orderBy(F.desc(F.abs("delta")), "category")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("year", "category", "delta", "year_delta", "rank")


def event_months(ledger: DataFrame, specs: DataFrame, top: int = 3) -> DataFrame:
    """Top categories of the month in which each event's category spent most: specs has event and category."""
    sums = category_month(ledger)
    w = Window.partitionBy("event").orderBy(F.desc("outflow"), "month")
    when = sums.join(F.broadcast(specs.withColumnRenamed("category", "wanted")), F.col("category") == F.col("wanted")).withColumn("rank", F.row_number().over(w)).where("rank = 1").select("event", "month")
    met = sums.join(F.broadcast(when), "month")
    rank = F.row_number().over(Window.partitionBy("event").orderBy(F.desc("outflow"), "category"))
    return met.withColumn("rank", rank).where(F.col("rank") <= top).select("event", "month", "category", "outflow", "rank")


def amortization_suggestions(ledger: DataFrame, excluded: tuple[str, ...] = (), minimum: float = 1500.0, months: int = 12, recurring: int = 3, rules: DataFrame | None = None) -> DataFrame:
    """Large single outflows that may be spread over a year; not of merchants seen in three other months or more, nor rows that have a rule."""
    rows = active(ledger).where((F.col("economic_class") == "household_spend") & (F.col("amount") <= -minimum) & ~F.coalesce(F.col("category").isin(*excluded), F.lit(False)))
    if rules is not None:
        rows = rows.join(rules.select(F.col("transaction_id").alias("id")).distinct(), "id", "left_anti")
    seen = burn(ledger).groupBy("merchant").agg(F.countDistinct(month()).alias("n_months"))
    met = rows.join(seen, "merchant", "left").where(F.coalesce("n_months", F.lit(1)) - 1 < recurring)
    start = F.date_format("txn_date", "yyyy-MM")
    end = F.date_format(F.add_months("txn_date", months - 1), "yyyy-MM")
    return met.select("id", F.abs("amount").cast(MONEY).alias("annual_amount"), F.round(F.abs("amount") / months, 2).cast(MONEY).alias("monthly_amount"), start.alias("start_month"), end.alias("end_month"))


def category_suggestions(totals: DataFrame, outflow: float = 2000.0, top: int = 6) -> DataFrame:
    """Buckets worth a slice of their own: much outflow, or two subcategories and more."""
    sums = totals.groupBy("category").agg(F.sum("outflow").cast(MONEY).alias("outflow"), F.countDistinct("subcategory").alias("n_subcategories"))
    return sums.where((F.col("outflow") >= outflow) | (F.col("n_subcategories") >= 2)).orderBy(F.desc("outflow"), "category").limit(top)


def rebucket(breakdown: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A breakdown summed by bucket label: the mean of confidences isn't weighted by their counts."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    label = F.coalesce(F.try_element_at(table, F.col("category")), F.col("category"))
    return breakdown.groupBy(label.alias("label")).agg(
        F.sum("outflow").cast(MONEY).alias("outflow"), F.sum("n").alias("n"), F.round(F.avg("avg_confidence"), 6).alias("avg_confidence"), F.array_join(F.array_sort(F.collect_set("subcategory")), ",").alias("subcategories")
    )


def nearest_rank(values: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The nearest-rank percentile of positive values."""
    return values.where(F.col(value) > 0).groupBy(*by).agg(F.expr(f"percentile_disc({p}) within group (order by {value})").alias("percentile"))


def month_audit(ledger: DataFrame, of: str, links: DataFrame | None = None, sort: str = "confidence") -> DataFrame:
    """A month's outflows with what is linked and left: link_state done (nothing left), linked or open."""
    orders = {
        "confidence": [F.asc("confidence"), F.asc("amount"), F.asc("id")],
        "amount": [F.asc("amount"), F.asc("confidence"), F.asc("id")],
        "date": [F.asc("txn_date"), F.asc("amount"), F.asc("id")],
    }
    first = F.to_date(F.lit(f"{of}-01"))
    rows = burn(ledger).where((F.col("txn_date") >= first) & (F.col("txn_date") < F.add_months(first, 1)))
    if links is None:
        rows = rows.withColumn("linked", F.lit(0).cast(MONEY))
    else:
        rows = rows.join(linked_per_outflow(links).withColumnRenamed("outflow_id", "id"), "id", "left").withColumn("linked", F.coalesce("linked", F.lit(0)).cast(MONEY))
    net = F.greatest(F.lit(0), -F.col("amount") - F.col("linked")).cast(MONEY)
    state = F.when((net == 0) | (F.col("confidence") >= 0.995), "done").when(F.col("linked") > 0, "linked").otherwise("open")
    return rows.select("id", "txn_date", "merchant", category().alias("category"), "confidence", F.col("amount").cast(MONEY).alias("amount"), "linked", net.alias("net_outflow"), state.alias("link_state")).orderBy(*orders[sort])


def month_income(ledger: DataFrame, of: str) -> DataFrame:
    first = F.to_date(F.lit(f"{of}-01"))
    rows = active(ledger).where((F.col("economic_class") == "income") & (F.col("amount") > 0) & (F.col("txn_date") >= first) & (F.col("txn_date") < F.add_months(first, 1)))
    return rows.select("id", "txn_date", "merchant", "category", F.col("amount").cast(MONEY).alias("amount")).orderBy(F.desc("amount"), "id")


def search(ledger: DataFrame, month_of: str | None = None, classes: tuple[str, ...] = (), categories: tuple[str, ...] = (), band: str | None = None, text: str | None = None, limit: int | None = 250) -> DataFrame:
    """Transactions by any of: month, classes, categories, confidence band, text; latest first. Duplicates are listed too."""
    rows = ledger
    if month_of:
        first = F.to_date(F.lit(f"{month_of}-01"))
        rows = rows.where((F.col("txn_date") >= first) & (F.col("txn_date") < F.add_months(first, 1)))
    if classes:
        rows = rows.where(F.col("economic_class").isin(*classes))
    if categories:
        rows = rows.where(category().isin(*categories))
    if band:
        rows = rows.where(confidence_band(F.col("confidence")) == band)
    if text:
        rows = rows.where(F.col("merchant").ilike(f"%{text}%"))
    rows = rows.orderBy(F.desc("txn_date"), F.desc("id"))
    return rows.limit(limit) if limit is not None else rows
