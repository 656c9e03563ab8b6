"""Aggregations that keep missing values apart from zeros."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantwell.plans.errors import QueryError

STATES = ["complete", "incomplete", "missing"]


def _difference(a: Column, b: Column) -> Column:
    """max(a - b, 0), null if either is null; `greatest` alone would skip the null."""
    return F.when((a - b).isNotNull(), F.greatest(a - b, F.lit(0)))


def base_value(kind: str, measures: list[Column], multiplier: Column | None = None, observed: date | None = None) -> Column:
    """The aggregate of a base aggregation, integrity aside."""
    x = measures[0]
    today = F.lit(observed).cast("date")
    zero = F.lit(0)
    if kind == "sum":
        return F.coalesce(F.sum(x), zero)
    if kind == "sum_product":
        return F.coalesce(F.sum(x * measures[1]), zero)
    if kind == "sum_product_many":
        return F.coalesce(F.sum(reduce(add, (F.coalesce(m, zero) for m in measures)) * multiplier), zero)
    if kind == "count_distinct":
        return F.count_distinct(x)
    if kind == "sum_positive":
        return F.coalesce(F.sum(F.when(x > 0, x).otherwise(zero)), zero)
    if kind in ("min", "max"):
        return F.min(x) if kind == "min" else F.max(x)
    if kind == "days_since_min":
        return F.datediff(today, F.min(x))
    if kind == "max_days_over":
        return F.greatest(F.coalesce(F.max(F.datediff(today, x) - measures[1]), zero), zero)
    if kind == "sum_positive_difference":
        return F.coalesce(F.sum(_difference(x, measures[1])), zero)
    if kind == "sum_positive_difference_product":
        return F.coalesce(F.sum(_difference(x, measures[1]) * multiplier), zero)
    raise QueryError("INVALID_PLAN", f"no aggregation {kind}")


def missing_inputs(kind: str, measures: list[Column], multiplier: Column | None = None) -> Column:
    """Whether a row lacks an input; a null that isn't counted is not one."""
    if kind == "count_distinct":
        return F.lit(False)
    return reduce(or_, (m.isNull() for m in [*measures, *([multiplier] if multiplier is not None else [])]))


def sealed(df: DataFrame, value: str = "metric_value") -> DataFrame:
    """From value, missing_value_count and row_count: the value nulled if inputs are missing, counts and state."""
    missing, known = F.col("missing_value_count"), F.col("row_count") - F.col("missing_value_count")
    return (
        df.withColumn("known_value_count", known)
        .withColumn("value_coverage_rate", F.when(F.col("row_count") > 0, F.round(known.cast("double") / F.col("row_count"), 6)))
        .withColumn("metric_data_state", F.when(missing == 0, "complete").when(known == 0, "missing").otherwise("incomplete"))
        .withColumn(value, F.when(missing == 0, F.col(value)))
    )


def aggregate(df: DataFrame, keys: list[str], kind: str, measures: list[Column], multiplier: Column | None = None, observed: date | None = None) -> DataFrame:
    """keys, metric_value, missing_value_count, row_count, known_value_count, value_coverage_rate, metric_data_state."""
    missing = missing_inputs(kind, measures, multiplier)
    grouped = df.groupBy(*keys).agg(base_value(kind, measures, multiplier, observed).alias("metric_value"), F.count_if(missing).alias("missing_value_count"), F.count("*").alias("row_count"))
    return sealed(grouped)


def overdue(df: DataFrame, keys: list[str], value: Column, billed: Column, credit_days: Column, observed: date) -> DataFrame:
    """Overdue sums with the coverage of their eligibility: rows without a date or a credit are counted, not judged."""
    today = F.lit(observed).cast("date")
    known = billed.isNotNull() & credit_days.isNotNull()
    late = known & (F.date_add(billed, credit_days) < today)
    count = lambda c: F.count_if(c)
    out = df.groupBy(*keys).agg(
        F.sum(F.when(late, value)).alias("eligible_value"),
        count(late & value.isNull()).alias("missing_value_count"),
        F.count("*").alias("scope_count"),
        count(~known).alias("unassessable_count"),
        count(known).alias("assessed_count"),
        count(late).alias("eligible_count"),
        count(credit_days.isNull()).alias("missing_credit_count"),
        count(billed.isNull()).alias("missing_date_count"),
    )
    whole = (F.col("unassessable_count") == 0) & (F.col("missing_value_count") == 0)
    zero = F.coalesce("eligible_value", F.lit(0).cast("decimal(38,4)"))
    return (
        out.withColumn("metric_value", F.when(whole, zero))
        .withColumn("assessed_subset_value", F.when(F.col("missing_value_count") == 0, zero))
        .withColumn("eligibility_coverage_rate", F.when(F.col("scope_count") > 0, F.round(F.col("assessed_count").cast("double") / F.col("scope_count"), 6)))
        .drop("eligible_value")
    )


def unclassified(keys: list[str], column: str, allowed: str = "^[A-Z]{3}$") -> list[Column]:
    """Evidence of values outside a pattern (a currency code): rows, single value, least and largest."""
    bad = F.col(column).isNull() | ~F.col(column).rlike(allowed)
    value = F.when(bad, F.col(column))
    return [
        F.count_if(bad).alias("unclassified_count"),
        F.when(F.count_distinct(value) == 1, F.max(value)).alias("unclassified_single"),
        F.min(value).alias("unclassified_min"),
        F.max(value).alias("unclassified_max"),
    ]


def single_label(column: str | Column) -> Column:
    """The label of a group if it has just one, else null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.count_distinct(c) == 1, F.max(c))


def endpoint_average(month: Column, value: Column, first: object, last: object, months: int) -> Column:
    """The average of monthly balances by trapezoids: both ends count half."""
    return F.sum(F.when(month.isin(first, last), value.cast("double") / 2).otherwise(value.cast("double"))) / months


def composite(parts: list[tuple[int, DataFrame]], keys: list[str]) -> DataFrame:
    """Signed sum of metrics aggregated apart: one union and one aggregation; a missing input anywhere nulls the group."""
    own = [df.select(*keys, (F.lit(sign) * F.coalesce("metric_value", F.lit(0))).cast("decimal(38,4)").alias("metric_value"), "missing_value_count", "row_count") for sign, df in parts]
    grouped = reduce(lambda a, b: a.unionByName(b), own).groupBy(*keys).agg(F.sum("metric_value").alias("metric_value"), F.sum("missing_value_count").alias("missing_value_count"), F.sum("row_count").alias("row_count"))
    return sealed(grouped)
