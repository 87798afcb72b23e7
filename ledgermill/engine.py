"""One object with a method for each question that callers ask of a ledger; every answer is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import analytics, calendar, cascade, detect, periods, snapshots


@dataclass
class Ledger:
    """transactions as operators take them; links (outflow_id, inflow_id, amount), amortisation rules and classification rules if there are any."""

    transactions: DataFrame
    links: DataFrame | None = None
    amortization_rules: DataFrame | None = None
    rules: DataFrame | None = None
    as_of: str | None = None

    def snapshots(self, period: str = "all") -> DataFrame:
        return periods.filter_period(snapshots.snapshots(self.transactions, self.links, self.amortization_rules), period, self.as_of)

    def within(self, period: str) -> DataFrame:
        """The transactions from the first to the last month of a period. The two bounds come to the driver, so that the scan has literal dates."""
        months = periods.filter_period(snapshots.months_of(self.transactions, self.amortization_rules), period, self.as_of)
        return periods.between(self.transactions, *periods.bounds(months).head())

    def fire(self, period: str = "last13", multiple: float = 25.0) -> DataFrame:
        return snapshots.fire_summary(self.snapshots(period), multiple, self.as_of)

    def yearly(self) -> DataFrame:
        return snapshots.yearly(self.snapshots())

    def spending(self, period: str = "all") -> DataFrame:
        return analytics.spending_breakdown(self.within(period))

    def buckets(self, period: str = "all") -> DataFrame:
        links = self.links if self.links is not None else self.transactions.select(F.col("id").alias("outflow_id"), F.col("id").alias("inflow_id"), "amount").limit(0)
        return analytics.bucket_totals(self.within(period), links)

    def optimization(self, controllability: dict[str, float], period: str = "last13") -> DataFrame:
        return analytics.optimization(self.within(period), controllability)

    def trends(self, period: str = "last13") -> DataFrame:
        return analytics.category_trends(self.within(period))

    def insights(self, period: str = "all") -> DataFrame:
        return analytics.yoy_shifts(self.within(period))

    def recurring(self, period: str = "last13") -> DataFrame:
        return analytics.recurring_merchants(self.within(period))

    def month_audit(self, month: str, sort: str = "confidence") -> DataFrame:
        return analytics.month_audit(self.transactions, month, self.links, sort)

    def month_income(self, month: str) -> DataFrame:
        return analytics.month_income(self.transactions, month)

    def search(self, **filters) -> DataFrame:
        return analytics.search(self.transactions, **filters)

    def drilldown(self, month: str, categories: tuple[str, ...], limit: int = 500) -> DataFrame:
        return analytics.month_audit(self.transactions, month).where(F.col("category").isin(*categories)).limit(limit)

    def data_health(self) -> DataFrame:
        return analytics.data_health(self.transactions)

    def review_items(self, by: list[str] | None = None) -> DataFrame:
        return detect.review_groups(self.transactions, by or ["merchant"])

    def rule_audit(self) -> DataFrame:
        if self.rules is None:
            raise ValueError("this ledger has no rules")
        return detect.rule_audit(self.transactions, self.rules)

    def amortization_suggestions(self, excluded: tuple[str, ...] = ()) -> DataFrame:
        return analytics.amortization_suggestions(self.transactions, excluded)

    def classify(self, hints: DataFrame | None = None, trips: DataFrame | None = None) -> DataFrame:
        """Every transaction through the cascade; the ledger must have the columns that `cascade` names."""
        return cascade.classify_all(self.transactions, self.rules, hints, trips)

    def review_queue(self, annotations: DataFrame) -> DataFrame:
        return cascade.review_items(cascade.with_texts(self.transactions), annotations)

    def rules_from(self, decisions: DataFrame) -> DataFrame:
        return cascade.rules_from_reviews(cascade.with_texts(self.transactions), decisions)

    def income_calendar(self, income: DataFrame) -> DataFrame:
        """Expected salaries, bonuses and stock proceeds with what came."""
        ledger = self.transactions.where("not is_duplicate")
        events = calendar.expected_salaries(income, ledger).unionByName(calendar.expected_bonuses(income, ledger)).unionByName(calendar.expected_stock(income, ledger))
        return calendar.observed(events, income)
