"""Whole analyses as DataFrame plans: turnover, settlement, outstanding days, targets, pools, flows, patterns."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantwell.operators.aggregates import endpoint_average, sealed
from quantwell.operators.compare import ranked, safe_ratio
from quantwell.operators.joins import align, exists_or_unknown, left_by, membership, semi_by, unique_parents
from quantwell.plans.periods import Period, shift_months


def _number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def month_spine(spark, first: date, last: date) -> DataFrame:
    """(month) firsts of months from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month"))).alias("month"))


def inventory_turnover(snapshots: DataFrame, flows: DataFrame, keys: list[str], period: Period) -> DataFrame:
    """Days of turnover: average inventory times days over net delivery.

    snapshots: keys, month, amount; flows: keys, month, net; period: whole months. The average of
    the months' balances takes in the month before the period; both ends count half. Months
    without any nonzero snapshot at all aren't accounted. Null if an input is missing, a month is
    not accounted or has no row, or the net is 0; `turnover_state` tells which comes first. Null
    keys are a group like any other; without keys there is one row, even if nothing is known.
    """
    if not keys:
        one = lambda df: df.withColumn("__all", F.lit(1))
        return _turnover(one(snapshots), one(flows), ["__all"], period, snapshots.sparkSession.range(1).select(F.lit(1).alias("__all"))).drop("__all")
    return _turnover(snapshots, flows, keys, period, None)


def _turnover(snapshots: DataFrame, flows: DataFrame, keys: list[str], period: Period, entities: DataFrame | None) -> DataFrame:
    months = period.whole_months
    first, last = shift_months(period.start, -1), shift_months(period.end, -1)
    spine = month_spine(snapshots.sparkSession, first, last)
    within = snapshots.where(F.col("month").between(F.lit(first), F.lit(last)))
    accounted = within.where("amount <> 0").select("month").distinct().withColumn("accounted", F.lit(1))
    spine = spine.join(F.broadcast(accounted), "month", "left")  # a row for each month
    monthly = within.groupBy(*keys, "month").agg(F.sum("amount").alias("amount"), F.count_if(F.col("amount").isNull()).alias("missing"))
    net = flows.where((F.col("month") >= F.lit(period.start)) & (F.col("month") < F.lit(period.end))).groupBy(*keys).agg(F.sum("net").alias("net"), F.count_if(F.col("net").isNull()).alias("net_missing"))
    if entities is None:
        entities = monthly.select(*keys).unionByName(net.select(*keys)).distinct()
    matrix = left_by(entities.crossJoin(F.broadcast(spine)), monthly, [*keys, "month"])  # the spine has months + 1 rows
    stock = matrix.groupBy(*keys).agg(
        endpoint_average(F.col("month"), _number(F.col("amount")), first, last, months).alias("average"),
        F.count_if(F.col("accounted").isNull()).alias("unready_months"),
        F.count_if(F.col("missing").isNull() & F.col("accounted").isNotNull()).alias("absent_months"),
        _number(F.sum("missing")).alias("missing"),
    )
    out = left_by(stock, net, keys)
    state = (
        F.when(F.col("unready_months") > 0, "accounting_not_ready").when(F.col("absent_months") > 0, "missing_snapshot").when(F.col("missing") > 0, "missing_value")
        .when(F.col("net").isNull() | (F.col("net_missing") > 0), "missing_net").when(F.col("net") == 0, "zero_net").otherwise("available")
    )
    days = F.round(F.col("average") * period.days / F.col("net").cast("double"), 4)
    out = out.withColumn("turnover_state", state)
    return out.select(*keys, "turnover_state", F.round(F.col("average"), 4).alias("average_inventory"), F.col("net").alias("net_delivery"), F.when(F.col("turnover_state") == "available", days).alias("turnover_days"))


#: Upper bounds of settlement bands in days, and their names in order.
SETTLEMENT_BANDS = (("0-30", 30), ("31-60", 60), ("61-90", 90), (">90", None))


def settlement_days(documents: DataFrame, keys: list[str]) -> DataFrame:
    """From rows (keys, document, billed, completed, open_amount): days to settlement by group.

    A document counts if all is settled, nothing is missing and its days aren't negative; the group
    stays even if none does. Gives average, maximum, quality counts and a count for each band.
    """
    missing = F.col("billed").isNull() | F.col("completed").isNull() | F.col("open_amount").isNull()
    each = documents.groupBy(*keys, "document").agg(F.datediff(F.min("completed"), F.min("billed")).alias("days"), F.max(F.col("open_amount") != 0).alias("open"), F.max(missing).alias("missing"))
    good = (F.col("days") >= 0) & ~_flag("open") & ~F.col("missing")
    bands, low = [], 0
    for name, high in SETTLEMENT_BANDS:
        inside = good & (F.col("days") >= low) & (F.lit(True) if high is None else F.col("days") <= high)
        bands.append(F.count_if(inside).alias(f"band_{name}"))
        low = (high or 0) + 1
    return each.groupBy(*keys).agg(
        F.round(F.avg(F.when(good, F.col("days"))), 6).alias("average_days"), F.max(F.when(good, F.col("days"))).cast("long").alias("maximum_days"), F.count_if(good).alias("eligible_count"),
        F.count_if(_flag("open")).alias("open_count"), F.count_if(F.col("missing")).alias("missing_count"), F.count("*").alias("document_count"), *bands,
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def days_sales_outstanding(debt: DataFrame, delivery: DataFrame, keys: list[str], period: Period) -> DataFrame:
    """Average debt times days over delivery, for whole months. debt and delivery: keys, month, amount.

    The debt needs a snapshot in each month and in the one before the period; groups without debt
    don't appear. Null keys are a group like any other; without keys there is one row.
    """
    if not keys:
        one = lambda df: df.withColumn("__all", F.lit(1))
        found = days_sales_outstanding(one(debt), one(delivery), ["__all"], period)
        return left_by(debt.sparkSession.range(1).select(F.lit(1).alias("__all")), found, ["__all"]).drop("__all")
    months = period.whole_months
    first, last = shift_months(period.start, -1), shift_months(period.end, -1)
    owed = debt.where(F.col("month").between(F.lit(first), F.lit(last))).groupBy(*keys, "month").agg(F.sum("amount").alias("amount"), F.count_if(F.col("amount").isNull()).alias("missing"))
    owed = owed.groupBy(*keys).agg(endpoint_average(F.col("month"), F.col("amount"), first, last, months).alias("average"), F.count("*").alias("n"), F.sum("missing").alias("missing"))
    sold = delivery.where((F.col("month") >= F.lit(period.start)) & (F.col("month") < F.lit(period.end))).groupBy(*keys).agg(F.sum("amount").alias("sold"), F.count_if(F.col("amount").isNull()).alias("sold_missing"))
    out = left_by(owed, sold, keys)
    ready = (F.col("n") == months + 1) & (F.col("missing") == 0)
    average = F.when(ready, F.round("average", 4))
    dso = F.when(ready & (F.col("sold") > 0) & (F.col("sold_missing") == 0), F.round(F.col("average") * period.days / F.col("sold").cast("double"), 4))
    return out.select(*keys, F.col("n").alias("snapshot_months"), average.alias("average_debt"), F.col("sold").alias("delivery_value"), dso.alias("dso_days"))


def paired_amounts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two sealed metrics side by side: difference, and coverage right / left where left is positive.

    Null where a side has no rows or lacks an input.
    """
    a = left.select(*keys, F.col("metric_value").alias("left_value"), F.col("row_count").alias("left_rows"))
    b = right.select(*keys, F.col("metric_value").alias("right_value"), F.col("row_count").alias("right_rows"))
    both = align(a, b, keys)
    return both.select(*keys, "left_value", "right_value", (F.col("left_value") - F.col("right_value")).alias("difference_value"), safe_ratio(F.col("right_value"), F.col("left_value")).alias("coverage_rate"), _number(F.col("left_rows")).alias("left_rows"), _number(F.col("right_rows")).alias("right_rows"))


def target_completion(target: DataFrame, actual: DataFrame, keys: list[str], period: Period, observed: date) -> DataFrame:
    """Sealed target and actual side by side: states, completion rate, gap, rank of the rate with ties and unknowns."""
    a = target.select(*keys, F.col("metric_value").alias("target_value"), F.col("row_count").alias("target_rows"), F.col("missing_value_count").alias("target_missing"))
    b = actual.select(*keys, F.col("metric_value").alias("actual_value"), F.col("row_count").alias("actual_rows"), F.col("missing_value_count").alias("actual_missing"))
    both = align(a, b, keys)
    state = period.state(observed)
    absent = "not_set_for_future" if state == "not_started" else "missing"
    both = both.withColumn("period_state", F.lit(state))
    both = both.withColumn("target_state", F.when(F.col("target_rows").isNull(), absent).when(F.col("target_missing") > 0, "incomplete").when(F.col("target_value") == 0, "zero").otherwise("set"))
    both = both.withColumn("actual_state", F.when(F.lit(state == "not_started"), "not_started").when(F.col("actual_rows").isNull(), "missing").when(F.col("actual_missing") > 0, "incomplete").otherwise("reported"))
    both = both.withColumn("completion_rate", safe_ratio(F.col("actual_value"), F.col("target_value"), "nonzero")).withColumn("gap_value", F.col("target_value") - F.col("actual_value"))
    return ranked(both.drop("target_rows", "target_missing", "actual_rows", "actual_missing"), "completion_rate")


def registered_pool(pool: DataFrame, keys: list[str], discount: Column) -> DataFrame:
    """Statistics of a pool (item, sku, quantity, rolls, price, label): sums, entries, distinct items, classes of labels and prices.

    `discount` is a condition on the label; where it is unknown, rolls count as unknown_label.
    """
    member = membership(discount)
    priced = F.col("price") > 0
    rolls = F.col("rolls")
    return pool.groupBy(*keys).agg(
        F.round(F.sum("quantity"), 4).alias("quantity"), F.sum("rolls").alias("rolls"), F.count("*").alias("entries"),
        F.count_distinct("item").alias("products"), F.count_distinct("sku").alias("skus"),
        _number(F.sum(F.when(member == 1, rolls))).alias("discount_rolls"), _number(F.sum(F.when(priced, rolls))).alias("priced_rolls"),
        _number(F.sum(F.when(priced & (member == 1), rolls))).alias("overlap_rolls"), _number(F.sum(F.when(member == -1, rolls))).alias("unknown_label_rolls"),
        _number(F.sum(F.when(F.coalesce(priced, F.lit(False)), 0).otherwise(rolls))).alias("unpriced_rolls"),
    )


def pool_comparison(base: DataFrame, current: DataFrame, keys: list[str], row: str, allowed: dict[str, tuple] | None = None) -> DataFrame:
    """Quantities (4 decimals) of two pools by key, and how each group moved.

    A row with a null in a key, or with a value outside `allowed` of that key, can't be
    followed: it stays apart under its own `uncertainty_key` (side and `row`) and is
    Unassessable, and so is every group that it could belong to, on either side. Else a group is
    New or Exited if one side has no rows, Unassessable if a quantity is missing, and Reduced,
    Increased or No Change by its quantities. A column `membership` (1, 0, -1) may stand in the
    pools: 0 leaves, -1 makes its group Unassessable and doesn't add to quantities.
    """
    allowed = allowed or {}
    known = {k: F.col(k).isin(list(allowed[k])) & F.col(k).isNotNull() if k in allowed else F.col(k).isNotNull() for k in keys}
    valid = F.coalesce(reduce(lambda a, b: a & b, known.values()), F.lit(False))

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        df = df if "membership" in df.columns else df.withColumn("membership", F.lit(1))
        df = df.where("membership <> 0").withColumn("uncertainty_key", F.when(valid, "").otherwise(F.concat(F.lit(f"{name}:"), F.col(row).cast("string"))))
        member = F.col("membership") == 1
        sums = df.groupBy(*keys, "uncertainty_key").agg(
            F.count_if(member).alias(f"{name}_rows"), F.round(F.sum(F.when(member, F.col("quantity"))), 4).alias(f"{name}_known_quantity"),
            F.count_if(F.col("quantity").isNull()).alias(f"{name}_missing_rows"), F.count_if(~member).alias(f"{name}_uncertain_rows"),
        )
        lost = df.where("uncertainty_key <> ''").select(*(F.when(known[k], F.col(k)).alias(k) for k in keys))
        return sums, lost

    (a, lost_a), (b, lost_b) = side(base, "base"), side(current, "current")
    both = align(a, b, [*keys, "uncertainty_key"])
    for c in ("base_rows", "current_rows", "base_missing_rows", "current_missing_rows", "base_uncertain_rows", "current_uncertain_rows"):
        both = both.withColumn(c, _number(F.col(c)))
    both = exists_or_unknown(both, lost_a.unionByName(lost_b), keys, "identity_uncertain")
    uncertain = F.col("identity_uncertain") | (F.col("uncertainty_key") != "")
    delta = F.round(F.col("current_known_quantity") - F.col("base_known_quantity"), 4)
    state = (
        F.when(uncertain | (F.col("base_uncertain_rows") + F.col("current_uncertain_rows") > 0), "Unassessable")
        .when((F.col("base_rows") == 0) & (F.col("current_rows") > 0), "New").when((F.col("base_rows") > 0) & (F.col("current_rows") == 0), "Exited")
        .when(F.col("base_missing_rows") + F.col("current_missing_rows") > 0, "Unassessable").when(delta < 0, "Reduced").when(delta > 0, "Increased").otherwise("No Change")
    )
    whole = lambda s: F.when(~uncertain & (F.col(f"{s}_missing_rows") == 0) & (F.col(f"{s}_uncertain_rows") == 0), F.col(f"{s}_known_quantity")).alias(f"{s}_quantity")
    out = both.withColumn("movement_state", state)
    return out.select(
        *keys, "uncertainty_key", "base_rows", "current_rows", whole("base"), whole("current"), "base_known_quantity", "current_known_quantity", "base_missing_rows", "current_missing_rows",
        F.when(F.col("movement_state").isin("Reduced", "No Change", "Increased"), delta).alias("delta_quantity"), uncertain.alias("identity_uncertain"), "movement_state",
    )


def movement_summary(compared: DataFrame, by: list[str]) -> DataFrame:
    """Groups, known quantities and changes of quantity by `by` and state."""
    return compared.groupBy(*by, "movement_state").agg(F.count("*").alias("groups"), F.sum("base_known_quantity").alias("base_quantity"), F.sum("current_known_quantity").alias("current_quantity"), F.sum("delta_quantity").alias("delta_quantity"))


def net_outbound(cohort: DataFrame, out: DataFrame, back: DataFrame, keys: list[str], start: date, end: date, factor: float = 0.75) -> DataFrame:
    """Outbound less returned quantities of a cohort's groups within [start, end).

    out: keys, at, quantity, price, list_price; back: keys, at, quantity. `high_price_quantity` sums
    what went out above factor times the list price. Groups without flows stay with zeros; flows
    outside the cohort never enter.
    """
    members = cohort.select(*keys).distinct()  # null keys are a group like any other
    inside = (F.col("at") >= F.lit(start)) & (F.col("at") < F.lit(end))
    gross = semi_by(out.where(inside), members, keys).groupBy(*keys).agg(
        F.sum("quantity").alias("gross"), F.count_if(F.col("quantity").isNull()).alias("gross_missing"),
        F.sum(F.when(F.col("price") > F.lit(factor).cast("decimal(4,2)") * F.col("list_price"), F.col("quantity"))).alias("high"),
    )
    returned = semi_by(back.where(inside), members, keys).groupBy(*keys).agg(F.sum("quantity").alias("returned"), F.count_if(F.col("quantity").isNull()).alias("returned_missing"))
    both = left_by(left_by(members, gross, keys), returned, keys)
    missing = (_number(F.col("gross_missing")) + _number(F.col("returned_missing"))).alias("missing_value_count")
    both = both.select(*keys, _number(F.col("gross")).alias("gross_quantity"), _number(F.col("returned")).alias("return_quantity"), _number(F.col("high")).alias("high_price_quantity"), missing)
    return both.withColumn("net_quantity", F.when(F.col("missing_value_count") == 0, F.col("gross_quantity") - F.col("return_quantity")))


def assessed(df: DataFrame, rules: list[tuple[str, Column]], default: str, name: str = "assessment") -> DataFrame:
    """The first rule that holds names each row; an unknown condition doesn't hold."""
    out = None
    for label, condition in rules:
        out = (F if out is None else out).when(F.coalesce(condition, F.lit(False)), label)
    return df.withColumn(name, out.otherwise(default))


def monthly_pool(snapshot: DataFrame, whitelist: DataFrame, keys: list[str], threshold: int = 10) -> DataFrame:
    """Groups of a physical snapshot above a threshold, products of the whitelist left out."""
    kept = snapshot.join(whitelist.select("item").distinct(), "item", "left_anti")
    return kept.groupBy(*keys).agg(F.sum("quantity").alias("quantity")).where(F.col("quantity") > threshold)


def customer_history(orders: DataFrame, returns: DataFrame, keys: list[str], read: date) -> DataFrame:
    """Relations of the 12 months before `read`: orders, first and last day, quantities out and back.

    A relation stays even if all came back.
    """
    start = shift_months(read, -12)
    inside = (F.col("at") >= F.lit(start)) & (F.col("at") < F.lit(read))
    out = orders.where(inside).groupBy(*keys).agg(F.count_distinct("order").alias("order_count"), F.min("at").cast("date").alias("first_day"), F.max("at").cast("date").alias("last_day"), F.sum("quantity").alias("quantity"))
    back = returns.where(inside).groupBy(*keys).agg(F.sum("quantity").alias("return_quantity"))
    return left_by(out, back, keys).withColumn("return_quantity", _number(F.col("return_quantity")))


def pattern_summary(tasks: DataFrame, keys: list[str], conditions: dict[str, Column], key: str = "task") -> DataFrame:
    """Distinct tasks for each condition. A task's rows are reduced to flags first, so that one count serves each condition."""
    flags = tasks.groupBy(*keys, key).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))
    return flags.groupBy(*keys).agg(F.count("*").alias("tasks"), *(F.count_if(F.col(n)).alias(n) for n in conditions))


def linked_amount(links: DataFrame, details: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Amounts of linked details, each detail once a group however many links lead to it.

    details that stand twice are ambiguous: counted in ambiguous_count, never picked.
    """
    parents = unique_parents(details, "detail", [amount])
    once = links.select(*keys, "detail").distinct().join(parents, "detail", "left")
    good = F.col("parent_count") == 1
    return once.groupBy(*keys).agg(F.sum(F.when(good, F.col(amount))).alias("linked_amount"), F.count_if(good).alias("linked_count"), F.count_if(F.col("parent_count") > 1).alias("ambiguous_count"), F.count_if(F.col("parent_count").isNull()).alias("absent_count"))


def unpriced(pool: DataFrame, by: str) -> DataFrame:
    """Rows of a pool without a price above 0, by unit, with the total of all units."""
    rows = pool.where(F.col("price").isNull() | (F.col("price") <= 0)).groupBy(by).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total"))))  # one row


def data_state(metric: DataFrame) -> DataFrame:
    """One row for a sealed metric: empty, undefined, incomplete, zero or rows."""
    s = metric.agg(F.sum("row_count").alias("rows"), F.sum("missing_value_count").alias("missing"), F.count("*").alias("groups"), F.count_if(F.col("metric_value") != 0).alias("nonzero"))
    state = F.when(_number(F.col("rows")) == 0, "empty").when(F.col("missing") == F.col("rows"), "undefined").when(F.col("missing") > 0, "incomplete").when((F.col("nonzero") == 0), "zero").otherwise("rows")
    return s.select(state.alias("data_state"), _number(F.col("rows")).alias("row_count"), _number(F.col("missing")).alias("missing_value_count"), "groups")


def allocated(ledgers: list[tuple[int, DataFrame]], keys: list[str], amount: str = "amount") -> DataFrame:
    """Signed ledgers of rows (keys, amount) under the integrity envelope: each is aggregated before they meet."""
    out = None
    for sign, df in ledgers:
        one = df.groupBy(*keys).agg((F.lit(sign) * _number(F.sum(amount))).cast("decimal(38,4)").alias("metric_value"), F.count_if(F.col(amount).isNull()).alias("missing_value_count"), F.count("*").alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return sealed(out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("metric_value", "missing_value_count", "row_count"))))
