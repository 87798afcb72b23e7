"""Pairs of related transactions: transfers, card settlements, refunds, reimbursements, offsets, and as-of rates.

Candidates are equi joins on exploded keys (a day and an amount in cents), never a product of all rows. One-to-one choices are rounds of
mutually best pairs over the candidate edges: an edge that is best for both its ends is taken, its ends leave, and so on; that gives
what taking edges one by one in order of their rank gives. Each round's edges are written to the shared folder and read again.
"""

from __future__ import annotations

import heapq
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import MOST_BROADCAST
from ..functions.storage import cut

MONEY = "decimal(18,2)"
#: Rows of one call that pairs equal amounts.
TASK_ROWS = 20_000
#: Blocks in which card settlements are bid for: bits of the cents and of the days.
BLOCK_CENTS, BLOCK_DAYS = 6, 6


def cents(amount: str = "amount") -> Column:
    return F.round(F.abs(F.col(amount)) * 100).cast("long")


def transfer_candidates(ledger: DataFrame, days: int = 3, carried: str | None = None) -> DataFrame:
    """(left_id, right_id, days, amount): equal amounts of opposite sign on two accounts within so many days.

    The join is on cents and a span of 2 * days + 1 days: a row's days around its own are in two spans at most, so a row is there once or twice however many days there are.
    The sides are inflows and outflows. A carried column is given as a for the inflow and b for the outflow.
    """
    more = [carried] if carried else []
    span = lambda day: F.floor(F.unix_date(day) / (2 * days + 1))
    rows = ledger.where("amount is not null and txn_date is not null").select("id", "account_id", "txn_date", "amount", *more, cents().alias("cents"))
    left = rows.where("amount > 0").withColumn("span", F.explode(F.sequence(span(F.date_sub("txn_date", days)), span(F.date_add("txn_date", days)))))
    right = rows.where("amount < 0").select(F.col("id").alias("r_id"), F.col("account_id").alias("r_account"), F.col("txn_date").alias("day"), *[F.col(c).alias("b") for c in more], "cents", span(F.col("txn_date")).alias("span"))
    met = left.join(right, ["cents", "span"]).where((F.col("account_id") != F.col("r_account")) & (F.abs(F.datediff("txn_date", "day")) <= days))
    return met.select(F.least("id", "r_id").alias("left_id"), F.greatest("id", "r_id").alias("right_id"), F.abs(F.datediff("txn_date", "day")).alias("days"), F.col("amount").cast(MONEY).alias("amount"), *[F.col(c).alias("a") for c in more], *["b" for _ in more])


def one_sided_pairs(edges: DataFrame, chooser: str, chosen: str, preference: list[str], order: list[str]) -> DataFrame:
    """Choosers in `order` each take the free partner they prefer: free choosers propose, a partner keeps its earliest proposer.

    Deferred acceptance gives what serial choice gives, and its rounds are joins. preference and order are ascending.
    """
    left = cut(edges)
    held: DataFrame | None = None
    while True:
        free = left if held is None else left.join(held.select(chooser), chooser, "left_anti")
        if free.isEmpty():
            return edges.limit(0) if held is None else held
        want = Window.partitionBy(chooser).orderBy(*preference, chosen)
        proposals = free.withColumn("__n", F.row_number().over(want)).where("__n = 1").drop("__n")
        bids = proposals if held is None else proposals.union(held)
        keep = Window.partitionBy(chosen).orderBy(*order, chooser)
        judged = cut(bids.withColumn("__n", F.row_number().over(keep)))
        held = judged.where("__n = 1").drop("__n")
        refused = judged.where("__n > 1").select(chooser, chosen)
        left = cut(left.join(refused, [chooser, chosen], "left_anti"))


def transfer_pairs(ledger: DataFrame, days: int = 3) -> DataFrame:
    """Transfers one to one: the closest day first, then the largest amount, then the least ids. No transaction stands in two pairs."""
    return equal_amount_pairs(ledger.withColumn("kind", F.lit(0)), [[0]], days).drop("rank")


class _Free:
    """Rows of one day, side and kind in order of id, of which some are taken: the first that is free, and the first of another account than that one's. Both only move on."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.first = self.other = 0

    def least(self, account, taken: set) -> tuple | None:
        rows = self.rows
        while self.first < len(rows) and rows[self.first][0] in taken:
            self.first += 1
        if self.first == len(rows) or rows[self.first][1] != account:
            return rows[self.first] if self.first < len(rows) else None
        self.other = max(self.other, self.first + 1)
        while self.other < len(rows) and (rows[self.other][0] in taken or rows[self.other][1] == account):
            self.other += 1
        return rows[self.other] if self.other < len(rows) else None


def _paired(rows: list[tuple], ranks: list[list[int | None]], days: int):
    """One-by-one choice among rows (id, account, day, inflow, kind) of one amount: ids ascend, each takes the least free one that fits; first at equal days, then one day apart, and so on."""
    taken: set = set()
    order = sorted({x for r in ranks for x in r if x is not None})
    rows.sort(key=lambda x: x[0])
    for gap in range(days + 1):
        for rank in order:
            free: dict[tuple, _Free] = {}
            rows = [x for x in rows if x[0] not in taken]
            for x in rows:
                free.setdefault((x[2], x[3], x[4]), _Free()).rows.append(x)
            for x in rows:
                if x[0] in taken:
                    continue
                kinds = [k for k in range(len(ranks)) if (ranks[x[4]][k] if x[3] else ranks[k][x[4]]) == rank]
                places = [free[p] for d in {x[2] - gap, x[2] + gap} for k in kinds if (p := (d, not x[3], k)) in free]
                if found := [y for place in places if (y := place.least(x[1], taken)) is not None]:
                    y = min(found)
                    taken |= {x[0], y[0]}
                    yield min(x[0], y[0]), max(x[0], y[0]), gap, rank


def equal_amount_pairs(ledger: DataFrame, ranks: list[list[int | None]], days: int) -> DataFrame:
    """(left_id, right_id, days, rank, amount): inflows and outflows of one amount, two accounts and at most so many days apart, one to one by (days, rank, falling amount, ids).

    Rows have a `kind` from 0; ranks[a][b] is the rank of an inflow of kind a with an outflow of kind b, null if they are no pair. Pairs are never listed before they are chosen: no pair
    joins two amounts, nor two runs of days with more than `days` between them, so each such run is gone through in order of ids, and a run costs about as much as it has rows.
    """
    rows = ledger.where("amount <> 0 and txn_date is not null and account_id is not null").select("id", "account_id", F.unix_date("txn_date").alias("day"), (F.col("amount") > 0).alias("inflow"), "kind", cents().alias("cents"))
    on = rows.groupBy("cents", "day").agg(F.bool_or("inflow").alias("has_in"), F.bool_or(~F.col("inflow")).alias("has_out"))
    by = Window.partitionBy("cents").orderBy("day")
    runs = on.withColumn("new", F.coalesce((F.col("day") - F.lag("day").over(by) > days).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by))
    both = runs.groupBy("cents", "run").agg(F.bool_or("has_in").alias("i"), F.bool_or("has_out").alias("o")).where("i and o").select("cents", "run")
    rows = cut(rows.join(runs.select("cents", "day", "run").join(both, ["cents", "run"]), ["cents", "day"]))
    share = F.pmod(F.xxhash64("cents", "run"), F.lit(max(1, rows.count() // TASK_ROWS)))  # many runs go to one call

    def choose(frame):
        groups: dict[tuple, list[tuple]] = {}
        for c, r, *x in zip(*(frame[n].tolist() for n in ("cents", "run", "id", "account_id", "day", "inflow", "kind"))):
            groups.setdefault((c, r), []).append(tuple(x))
        return pd.DataFrame([(*p, c) for (c, _), mine in groups.items() for p in _paired(mine, ranks, days)], columns=["left_id", "right_id", "days", "rank", "cents"])

    pairs = cut(rows.groupBy(share.alias("share")).applyInPandas(choose, "left_id long, right_id long, days int, rank int, cents long"))
    return pairs.select("left_id", "right_id", "days", "rank", (F.col("cents").cast("decimal(20,0)") / 100).cast(MONEY).alias("amount"))


def both_ends_pairs(edges: DataFrame, rank: list[str]) -> DataFrame:
    """The edges that one-by-one choice in order of `rank` (ascending, a total order with the ends) takes; an id may stand on either side, and is used once."""
    left = cut(edges)
    order = F.struct(*rank, "left_id", "right_id")
    taken: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("left_id", "right_id")).alias("end"), order.alias("order"))
        best = ends.groupBy("end").agg(F.min("order").alias("best"))
        # An edge that is best for both of its ends stands there twice.
        twice = best.groupBy("best").agg(F.count("*").alias("n")).where("n = 2").select("best.*")
        chosen = cut(left.join(twice, [*rank, "left_id", "right_id"]).select(*edges.columns))
        taken.append(chosen)
        gone = chosen.select(F.explode(F.array("left_id", "right_id")).alias("end"))
        left = cut(left.join(gone.withColumnRenamed("end", "left_id"), "left_id", "left_anti").join(gone.withColumnRenamed("end", "right_id"), "right_id", "left_anti"))
    out = edges.limit(0) if not taken else taken[0]
    for x in taken[1:]:
        out = out.union(x)
    return out


def settlement_candidates(bank: DataFrame, card: DataFrame, days: int = 7) -> DataFrame:
    """(bank_id, card_id, gap, bank_date, card_date): outflows and card credits within a cent and so many days."""
    b = bank.where("amount < 0").select(F.col("id").alias("bank_id"), F.col("txn_date").alias("bank_date"), cents().alias("own"))
    b = b.withColumn("cents", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    c = card.where("amount > 0").select(F.col("id").alias("card_id"), F.col("txn_date").alias("card_date"), cents().alias("cents"))
    # Weeks on both sides keep a frequent amount from meeting all its rows.
    week = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / (days or 1))
    b = b.withColumn("week", F.explode(F.sequence(week(F.col("bank_date")) - 1, week(F.col("bank_date")) + 1)))
    met = b.join(c.withColumn("week", week(F.col("card_date"))), ["cents", "week"])
    gap = F.abs(F.datediff("bank_date", "card_date"))
    return met.where(gap <= days).select("bank_id", "card_id", gap.alias("gap"), "bank_date", "card_date")


def _bids(banks: list[tuple], cards: dict[tuple, tuple[list, list]], days: int, mine) -> None:
    """Deferred acceptance of bank rows (day, id, cents) in this order; cards has by (cents, day) the ids, ascending, and who holds them. One who loses a card bids on if it is `mine`.

    Bidders only rise, so what an earlier one holds is gone for good, and the first card of a list that may still be had only moves on.
    """
    heapq.heapify(banks)
    at = dict.fromkeys(cards, 0)
    while banks:
        who = heapq.heappop(banks)
        for day in sorted(range(who[0] - days, who[0] + days + 1), key=lambda d: (abs(d - who[0]), d)):
            found = None
            for key in ((who[2] + x, day) for x in (-1, 0, 1)):
                if key not in cards:
                    continue
                (ids, held), i = cards[key], at[key]
                while i < len(ids) and held[i] is not None and held[i] < who:
                    i += 1
                at[key] = i
                if i < len(ids) and (found is None or ids[i] < found[0]):
                    found = ids[i], held, i
            if found:
                _, held, i = found
                before, held[i] = held[i], who
                if before is not None and mine(before):
                    heapq.heappush(banks, before)
                break


def settlement_pairs(bank: DataFrame, card: DataFrame, days: int = 7) -> DataFrame:
    """Each bank row, by (date, id), takes the closest free card row; ties by the card row's (date, id).

    Deferred acceptance gives this in whatever order bids come. So blocks of cents and days, with the cards just outside them, each go through all their own bids; then a card of several blocks
    stays with its earliest bidder, and who lost it bids on in the next round, whose blocks begin half a block further on. No pair is listed before it is chosen, and a round costs about as much as there are rows.
    """
    side = lambda value, bits: F.shiftright(value + (moved << bits - 1), bits)
    mine = lambda who, at, moved: (who[2] + (moved << BLOCK_CENTS - 1) >> BLOCK_CENTS, who[0] + (moved << BLOCK_DAYS - 1) >> BLOCK_DAYS) == at
    rows = lambda frame: frame.where("txn_date is not null").select("id", F.unix_date("txn_date").cast("long").alias("day"), cents().alias("cents"))
    who = "struct<day:bigint,id:bigint,cents:bigint>"
    cards = cut(rows(card.where("amount > 0")).withColumn("held", F.lit(None).cast(who)))
    spread = lambda c: c.withColumn("x", F.explode(F.sequence(*[side(F.col("cents") + e, BLOCK_CENTS) for e in (-1, 1)]))).withColumn("y", F.explode(F.sequence(*[side(F.col("day") + e, BLOCK_DAYS) for e in (-days, days)])))
    placed = lambda b: b.select("id", "day", "cents", side(F.col("cents"), BLOCK_CENTS).alias("x"), side(F.col("day"), BLOCK_DAYS).alias("y"))
    moved = 0
    free = cut(placed(rows(bank.where("amount < 0"))).join(spread(cards).select("x", "y").distinct(), ["x", "y"], "left_semi"))
    n_cards = cards.count()

    def settle(frame, moved):
        blocks: dict[tuple, tuple[list, dict]] = {}
        for x, y, is_card, i, day, c, has, *held in zip(*(frame[n].tolist() for n in ("x", "y", "is_card", "id", "day", "cents", "has", "h_day", "h_id", "h_cents"))):
            banks, own = blocks.setdefault((x, y), ([], {}))
            if is_card:
                own.setdefault((c, day), []).append((i, tuple(held) if has else None))
            else:
                banks.append((day, i, c))
        out = []
        for at, (banks, own) in blocks.items():
            lists = {k: tuple(map(list, zip(*sorted(v, key=lambda x: x[0])))) for k, v in own.items()}
            before = {k: list(held) for k, (_, held) in lists.items()}
            _bids(banks, lists, days, lambda w: mine(w, at, moved))  # noqa: B023
            for k, (ids, held) in lists.items():
                for i, old, new in zip(ids, before[k], held):
                    if new is not None:
                        out.append((i, *new, new != old, old is not None and mine(old, at, moved)))
        return pd.DataFrame(out, columns=["id", "n_day", "n_id", "n_cents", "changed", "old_here"])

    while (n_free := free.count()) > 0:
        there = spread(cards).join(free.select("x", "y").distinct(), ["x", "y"], "left_semi")
        h = lambda n: F.coalesce(F.col(f"held.{n}"), F.lit(0).cast("long")).alias(f"h_{n}")
        both = there.select("x", "y", F.lit(True).alias("is_card"), "id", "day", "cents", F.col("held").isNotNull().alias("has"), h("day"), h("id"), h("cents"))
        zero = F.lit(0).cast("long")
        both = both.unionByName(free.select("x", "y", F.lit(False).alias("is_card"), "id", "day", "cents", F.lit(False).alias("has"), *[zero.alias(f"h_{n}") for n in ("day", "id", "cents")]))
        share = F.pmod(F.xxhash64("x", "y"), F.lit(max(1, (n_free + n_cards) // TASK_ROWS)))  # many blocks go to one call
        new = both.groupBy(share.alias("share")).applyInPandas(partial(settle, moved=moved), "id long, n_day long, n_id long, n_cents long, changed boolean, old_here boolean")
        bid = F.struct(F.col("n_day").alias("day"), F.col("n_id").alias("id"), F.col("n_cents").alias("cents"))
        # Who held a card before is followed by its own block: there it bids on, or still holds it.
        best = new.groupBy("id").agg(F.min(bid).alias("best"), F.collect_set(F.when(F.col("changed") | F.col("old_here"), bid)).alias("bids"), F.bool_or("old_here").alias("followed"))
        joined = cards.join(best, "id", "left")
        lost = F.filter(F.coalesce(F.when(F.col("followed") | F.col("held").isNull(), F.col("bids")).otherwise(F.array_append("bids", F.col("held"))), F.array().cast(f"array<{who}>")), lambda x: x != F.col("best"))
        state = cut(joined.select("id", "day", "cents", F.coalesce("best", "held").alias("held"), F.array_distinct(lost).alias("lost")))
        cards, moved = state.drop("lost"), 1 - moved
        free = cut(placed(state.select(F.explode("lost").alias("w")).select("w.*")))
    return cards.where("held is not null").select(F.col("held.id").alias("bank_id"), F.col("id").alias("card_id"), F.abs(F.col("day") - F.col("held.day")).cast("int").alias("gap"))


def _months_back(date: Column, days: int) -> Column:
    """The months (numbered) that the days before a date touch."""
    number = lambda d: F.year(d) * 12 + F.month(d)
    return F.explode(F.sequence(number(F.date_sub(date, days)), number(date)))


def refund_pairs(inflows: DataFrame, outflows: DataFrame, key: list[str], days: int = 120, least: float = 10.0, share: float = 0.2) -> DataFrame:
    """Each inflow with the earliest outflow (date, id) of the same key, at most so many days before, of about its amount. Outflows may be shared."""
    i = inflows.where("amount > 0").select("id", *key, "txn_date", "amount", _months_back(F.col("txn_date"), days).alias("m"))
    o = outflows.where("amount < 0").select(F.col("id").alias("outflow_id"), *key, F.col("txn_date").alias("out_date"), F.abs("amount").alias("spent"), (F.year("txn_date") * 12 + F.month("txn_date")).alias("m"))
    met = i.join(o, [*key, "m"]).where((F.col("out_date") <= F.col("txn_date")) & (F.datediff("txn_date", "out_date") <= days))
    near = F.abs(F.col("spent") - F.col("amount")) <= F.greatest(F.lit(least), F.col("amount") * share)
    first = met.where(near).groupBy("id").agg(F.min(F.struct("out_date", "outflow_id", "spent")).alias("best"), F.min("amount").alias("amount"))
    return first.select(F.col("id").alias("inflow_id"), F.col("best.outflow_id").alias("outflow_id"), F.col("best.out_date").alias("outflow_date"), F.col("amount").cast(MONEY).alias("amount"))


def reimbursement_candidates(inflows: DataFrame, outflows: DataFrame, key: list[str], days: int = 60, least: float = 1.0, share: float = 0.02) -> DataFrame:
    i = inflows.where("amount > 0").select(F.col("id").alias("inflow_id"), *key, F.col("txn_date").alias("in_date"), "amount", _months_back(F.col("txn_date"), days).alias("m"))
    o = outflows.where("amount < 0").select(F.col("id").alias("outflow_id"), *key, F.col("txn_date").alias("out_date"), F.abs("amount").alias("spent"), (F.year("txn_date") * 12 + F.month("txn_date")).alias("m"))
    met = i.join(o, [*key, "m"]).where((F.col("out_date") <= F.col("in_date")) & (F.datediff("in_date", "out_date") <= days))
    difference = F.abs(F.col("spent") - F.col("amount"))
    met = met.where(difference <= F.greatest(F.lit(least), F.col("amount") * share))
    return met.select("inflow_id", "outflow_id", "in_date", difference.cast(MONEY).alias("difference"), (-F.datediff("out_date", F.lit("1970-01-01").cast("date"))).alias("late"), F.least("amount", "spent").cast(MONEY).alias("amount"))


def reimbursement_links(inflows: DataFrame, outflows: DataFrame, key: list[str], minimum: float = 500.0, **limits) -> DataFrame:
    """Inflows by (date, id) each take the free outflow nearest in amount, then the latest; one outflow serves one inflow."""
    edges = reimbursement_candidates(inflows.where(F.col("amount") >= minimum), outflows, key, **limits)
    pairs = one_sided_pairs(edges, "inflow_id", "outflow_id", ["difference", "late"], ["in_date"])
    confidence = F.when(F.col("difference") < 0.01, 0.98).otherwise(0.92)
    return pairs.select("inflow_id", "outflow_id", "amount", confidence.alias("confidence"))


def nearest_offset(inflows: DataFrame, outflows: DataFrame, key: list[str], days: int = 365, ratio: float = 3.0) -> DataFrame:
    """Each inflow with the outflow nearest in time (then the least id) that is at least `ratio` times as large; outflows may be shared."""
    number = lambda d: F.year(d) * 12 + F.month(d)
    i = inflows.where("amount > 0").select("id", *key, "txn_date", "amount", F.explode(F.sequence(number(F.date_sub("txn_date", days)), number(F.date_add("txn_date", days)))).alias("m"))
    o = outflows.where("amount < 0").select(F.col("id").alias("outflow_id"), *key, F.col("txn_date").alias("out_date"), F.abs("amount").alias("spent"), number(F.col("txn_date")).alias("m"))
    gap = F.abs(F.datediff("txn_date", "out_date"))
    met = i.join(o, [*key, "m"]).where((gap <= days) & (F.col("spent") >= F.col("amount") * ratio))
    best = met.groupBy("id").agg(F.min(F.struct(gap.alias("gap"), "outflow_id")).alias("best"))
    return best.select(F.col("id").alias("inflow_id"), "best.outflow_id", "best.gap")


def best_later_inflow(outflows: DataFrame, inflows: DataFrame, key: list[str], days: int = 60, least: float = 1.0, share: float = 0.02) -> DataFrame:
    """Each outflow with the inflow of about its amount in the days after it that is nearest in amount, then the earliest."""
    number = lambda d: F.year(d) * 12 + F.month(d)
    o = outflows.where("amount < 0").select("id", *key, "txn_date", F.abs("amount").alias("spent"), F.explode(F.sequence(number(F.col("txn_date")), number(F.date_add("txn_date", days)))).alias("m"))
    i = inflows.where("amount > 0").select(F.col("id").alias("inflow_id"), *key, F.col("txn_date").alias("in_date"), F.col("amount").alias("received"), number(F.col("txn_date")).alias("m"))
    gap = F.datediff("in_date", "txn_date")
    difference = F.abs(F.col("spent") - F.col("received"))
    met = o.join(i, [*key, "m"]).where((gap >= 0) & (gap <= days) & (difference <= F.greatest(F.lit(least), F.col("spent") * share)))
    best = met.groupBy("id").agg(F.min(F.struct(difference.cast(MONEY).alias("difference"), "in_date", "inflow_id")).alias("best"))
    return best.select(F.col("id").alias("outflow_id"), "best.inflow_id", "best.difference")


def asof(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, value: str, alias: str) -> DataFrame:
    """left with the latest value of the same key at or before its time; null before the first.

    Two levels: values are reduced to the last one of each key and day, and one scan over these few rows carries it to the days after. Rows whose day has no values of its own take what
    is carried to it by a join on (key, day), and so do all rows if both times are dates. Only in days of rows and values with times of day does a window order both; no window is
    over a whole key.
    """
    names, kinds = left.columns, dict(left.dtypes)
    right = right.where(F.col(value).isNotNull() & F.col(right_time).isNotNull() & F.col(key).isNotNull())
    values = right.select(F.col(key).alias("__key"), F.to_date(right_time).alias("__day"), F.col(right_time).alias("__t"), F.col(value).alias("__v"))
    rows = left.withColumns({"__key": F.col(key), "__day": F.to_date(time)})
    lasts = values.groupBy("__key", "__day").agg(F.max(F.struct("__t", "__v")).alias("last"))
    days = rows.select("__key", "__day").where("__key is not null and __day is not null").distinct()
    w = Window.partitionBy("__key").orderBy("__day")
    carried = lambda upto: F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, upto))["__v"]
    heads = cut(days.join(lasts, ["__key", "__day"], "full").select("__key", "__day", carried(0).alias("__upto"), carried(-1).alias("__before"), F.col("last").isNotNull().alias("__own")))
    met = rows.join(F.broadcast(heads) if heads.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else heads, ["__key", "__day"], "left")
    if kinds[time] == "date" and dict(right.dtypes)[right_time] == "date":
        return met.select(*names, F.col("__upto").alias(alias))
    plain = met.where(~F.coalesce("__own", F.lit(False))).select(*names, F.col("__before").alias(alias))
    inside = met.where("__own").withColumns({"__t": F.col(time), "__side": F.lit(1), "__v": F.lit(None).cast(dict(right.dtypes)[value])})
    there = values.join(heads.where("__own").select("__key", "__day"), ["__key", "__day"], "left_semi")
    guests = there.select(*[F.lit(None).cast(k).alias(c) for c, k in left.dtypes], "__key", "__day", F.lit(None).cast(dict(right.dtypes)[value]).alias("__before"), "__t", F.lit(0).alias("__side"), "__v")
    both = inside.select(*guests.columns).unionByName(guests)
    own = F.last("__v", ignorenulls=True).over(Window.partitionBy("__key", "__day").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0))
    return plain.unionByName(both.withColumn(alias, F.coalesce(own, "__before")).where("__side = 1").select(*names, alias))
