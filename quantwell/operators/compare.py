"""Comparisons, ratios and proofs over whole partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantwell.operators.joins import align


def safe_ratio(numerator: Column, denominator: Column, policy: str = "positive") -> Column:
    """numerator / denominator as a double rounded to 6 places; null unless the policy allows the denominator."""
    allowed = denominator > 0 if policy == "positive" else denominator != 0
    return F.when(allowed, F.round(numerator.cast("double") / denominator.cast("double"), 6))


def ratio(numerator: DataFrame, denominator: DataFrame, keys: list[str], policy: str = "positive") -> DataFrame:
    """keys, numerator_value, denominator_value, metric_value."""
    a = numerator.select(*keys, F.col("metric_value").alias("numerator_value"))
    b = denominator.select(*keys, F.col("metric_value").alias("denominator_value"))
    return align(a, b, keys).withColumn("metric_value", safe_ratio(F.col("numerator_value"), F.col("denominator_value"), policy))


def compare(current: DataFrame, prior: DataFrame, keys: list[str], *, zero_if_absent: bool = True) -> DataFrame:
    """keys, metric_value, comparison_value, delta_value, change_rate (null unless the prior value is positive).

    A group that one side lacks counts as 0 there for additive metrics, and as unknown otherwise;
    a group whose inputs are missing stays null.
    """
    a = current.select(*keys, F.col("metric_value"), F.lit(True).alias("has_current"))
    b = prior.select(*keys, F.col("metric_value").alias("comparison_value"), F.lit(True).alias("has_prior"))
    both = align(a, b, keys)
    if zero_if_absent:
        both = both.withColumn("metric_value", F.when(F.col("has_current").isNull(), F.lit(0)).otherwise(F.col("metric_value"))).withColumn("comparison_value", F.when(F.col("has_prior").isNull(), F.lit(0)).otherwise(F.col("comparison_value")))
    delta = F.col("metric_value") - F.col("comparison_value")
    return both.drop("has_current", "has_prior").withColumn("delta_value", delta).withColumn("change_rate", safe_ratio(F.col("delta_value"), F.col("comparison_value")))


def compared(both: DataFrame, keys: list[str], side: str, *, zero_if_absent: bool = True) -> DataFrame:
    """As compare, from one frame whose `side` is 0 for the current values and 1 for the prior ones."""
    now, before = F.col(side) == 0, F.col(side) == 1
    out = both.groupBy(*keys).agg(
        F.max(F.when(now, F.col("metric_value"))).alias("metric_value"), F.max(F.when(before, F.col("metric_value"))).alias("comparison_value"),
        F.count_if(now).alias("has_current"), F.count_if(before).alias("has_prior"),
    )
    if zero_if_absent:
        out = out.withColumn("metric_value", F.when(F.col("has_current") == 0, F.lit(0)).otherwise(F.col("metric_value"))).withColumn("comparison_value", F.when(F.col("has_prior") == 0, F.lit(0)).otherwise(F.col("comparison_value")))
    delta = F.col("metric_value") - F.col("comparison_value")
    return out.drop("has_current", "has_prior").withColumn("delta_value", delta).withColumn("change_rate", safe_ratio(F.col("delta_value"), F.col("comparison_value")))


def with_totals(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Every row with totals over all rows: one aggregation and a broadcast of its single row, no global window."""
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(n) for n, c in sums.items()))))


def partition_proof(compared: DataFrame) -> DataFrame:
    """Adds to a comparison the sums of its three columns and its group count before any limit."""
    return with_totals(compared, {"partition_value": F.sum("metric_value"), "partition_comparison": F.sum("comparison_value"), "partition_delta": F.sum("delta_value"), "partition_groups": F.count("*"), "partition_unknown": F.count_if(F.col("delta_value").isNull())})


def distribution(compared: DataFrame) -> DataFrame:
    """One row on the changes of all groups: counts by sign, signed sums, the largest decline."""
    d = F.col("delta_value")
    return compared.agg(
        F.count_if(d > 0).alias("positive_count"), F.count_if(d < 0).alias("negative_count"), F.count_if(d == 0).alias("zero_count"), F.count_if(d.isNull()).alias("unknown_count"),
        F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias("positive_sum"), F.coalesce(F.sum(F.when(d < 0, d)), F.lit(0)).alias("negative_sum"), F.min(F.when(d < 0, d)).alias("largest_decline"),
    )


def decompose(compared: DataFrame, overall: DataFrame) -> DataFrame:
    """Contributions delta / overall delta of a complete partition.

    They are given only if the groups add up exactly to the overall value, comparison and delta,
    none is unknown and the overall delta isn't 0; `reconciled` and `reason` tell.
    """
    total = overall.select(F.col("metric_value").alias("overall_value"), F.col("comparison_value").alias("overall_comparison"), F.col("delta_value").alias("overall_delta"))
    out = partition_proof(compared).crossJoin(F.broadcast(total))  # one row
    reason = (
        F.when(F.col("partition_unknown") > 0, "unknown_group")
        .when(F.col("overall_delta").isNull(), "unknown_overall")
        .when(F.col("partition_value") != F.col("overall_value"), "value_mismatch")
        .when(F.col("partition_comparison") != F.col("overall_comparison"), "comparison_mismatch")
        .when(F.col("partition_delta") != F.col("overall_delta"), "delta_mismatch")
        .when(F.col("overall_delta") == 0, "zero_overall_change")
    )
    share = F.round(F.col("delta_value").cast("double") / F.col("overall_delta").cast("double"), 6)
    return out.withColumn("reason", reason).withColumn("reconciled", F.col("reason").isNull()).withColumn("net_change_contribution_rate", F.when(F.col("reconciled"), share))


#: Stretches of values whose ranks are counted apart.
STRETCHES = 64


def ranked(df: DataFrame, value: str, *, descending: bool = True) -> DataFrame:
    """rank (nulls last), tie_count, population_count and unknown_count of each row; `value` is numeric or a date.

    Ranks come from counts by distinct value. Bounds (approximate quantiles, which only deal out the
    work) cut the values into stretches; ranks are counted within each and the counts of the
    stretches before are added, so no task orders all values. Finding the bounds runs a job.
    """
    levels = df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("tie_count"))
    bounds = df.agg(F.percentile_approx(value, [k / STRETCHES for k in range(1, STRETCHES)], 1000).alias("b")).first()["b"]
    v, zero = F.col("__v"), F.lit(0)
    above = sum((F.when(v > F.lit(b), 1).otherwise(0) for b in sorted(set(bounds or ()))), zero)
    levels = levels.withColumn("__s", F.when(v.isNull(), STRETCHES).otherwise(STRETCHES - above if descending else above))
    if descending:
        levels = levels.withColumn("__s", F.when(v.isNull(), STRETCHES + 1).otherwise(F.col("__s")))
    totals = levels.groupBy("__s").agg(F.sum("tie_count").alias("__n"))  # STRETCHES + 1 rows at most
    earlier = F.sum("__n").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.withColumn("__before", F.coalesce(earlier, zero)).drop("__n")
    within = F.sum("tie_count").over(W.partitionBy("__s").orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1))
    levels = levels.withColumn("__w", F.coalesce(within, zero)).join(F.broadcast(totals), "__s")
    levels = levels.select("__v", "tie_count", (F.col("__before") + F.col("__w") + 1).cast("long").alias("rank"))
    out = df.join(levels, F.col(value).eqNullSafe(v)).drop("__v")
    return with_totals(out, {"population_count": F.count("*"), "unknown_count": F.count_if(F.col(value).isNull())})


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first rows of each key in an order, ties kept."""
    return df.withColumn("__d", F.dense_rank().over(W.partitionBy(*keys).orderBy(*order))).where("__d = 1").drop("__d")


def decompose_gap(parts: DataFrame, overall: DataFrame) -> DataFrame:
    """Shares gap / overall gap of a complete partition of a target gap (target_value, actual_value, gap_value).

    Given only if all three columns add up exactly, no group is unknown and the overall gap isn't 0.
    """
    columns = ("target_value", "actual_value", "gap_value")
    unknown = F.count_if(F.col("gap_value").isNull())
    out = with_totals(parts, {f"partition_{c}": F.sum(c) for c in columns} | {"partition_unknown": unknown})
    out = out.crossJoin(F.broadcast(overall.select(*(F.col(c).alias(f"overall_{c}") for c in columns))))  # one row
    exact = (F.col("partition_unknown") == 0) & (F.col("overall_gap_value") != 0)
    for c in columns:
        exact = exact & (F.col(f"partition_{c}") == F.col(f"overall_{c}"))
    out = out.withColumn("reconciled", F.coalesce(exact, F.lit(False)))
    share = F.round(F.col("gap_value").cast("double") / F.col("overall_gap_value").cast("double"), 6)
    return out.withColumn("gap_contribution_rate", F.when(F.col("reconciled"), share))
