"""Joins that neither multiply nor drop facts, and null-safe alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masters of at most so many bytes by the optimizer's estimate are broadcast.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast only if its estimated size is within the limit; else the plan stays free to shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def enrich(facts: DataFrame, master: DataFrame, on: dict[str, str], columns: dict[str, str], condition: Column | None = None) -> DataFrame:
    """Many-to-one: each fact stays, with columns of the master row that it matches.

    on: fact column to master column; columns: output name to master column. A condition on the
    master goes before the join, so that facts without a match keep their place with nulls.
    """
    side = master if condition is None else master.where(condition)
    keys = {f"__k{i}": m for i, m in enumerate(on.values())}
    side = side.select(*(F.col(m).alias(k) for k, m in keys.items()), *(F.col(m).alias(o) for o, m in columns.items()))
    match = reduce(lambda a, b: a & b, (F.col(f) == F.col(k) for f, k in zip(on, keys, strict=True)))
    return facts.join(sized(side), match, "left").drop(*keys)


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by null-safe equality of keys: one shuffle a side, null keys meet null keys.

    Other columns must have different names. Without keys the two single rows stand side by side.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))  # aggregates without keys: one row each
    renamed = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys), F.lit(True).alias("__right"))
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    both = left.withColumn("__left", F.lit(True)).join(renamed, match, "full_outer")
    merged = [F.when(F.col("__left"), F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys]
    return both.select(*merged, *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys))


def left_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join by null-safe equality of keys: null keys meet null keys; other columns must have different names.

    `right` has a row for each key at most, so rows never multiply; without keys it is one row.
    """
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), "left")  # one row
    renamed = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    return left.join(renamed, match, "left").drop(*(f"__r_{k}" for k in keys))


def semi_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose keys `right` has, null keys included."""
    renamed = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys))
    return left.join(renamed, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys)), "left_semi")


def exists_or_unknown(df: DataFrame, uncertain: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Flags rows with whole keys that a row of `uncertain` may belong to: each of its keys is null or equal.

    Rows are looked up under each way of forgetting keys, 2 ** keys - 1 of them, in one
    null-safe equi-join; `uncertain` is reduced to its distinct keys first.
    """
    forms = [[F.when(F.lit(bool(mask >> i & 1)), F.col(k)).alias(k) for i, k in enumerate(keys)] for mask in range(2 ** len(keys) - 1)]
    whole = df.select(*keys).distinct()
    asked = whole.select(F.struct(*keys).alias("__own"), F.explode(F.array(*(F.struct(*form) for form in forms))).alias("__form")).select("__own", "__form.*")
    met = semi_by(asked, uncertain.select(*keys).distinct(), keys).select("__own.*").distinct()
    return left_by(df, met.withColumn(name, F.lit(True)), keys).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def keep_metadata(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of metadata beside each row, or alone if there are none."""
    return meta.join(rows, F.lit(True), "left")


def unique_parents(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key with the columns of its only row; nulls, and parent_count, where it has several."""
    out = df.groupBy(key).agg(F.count("*").alias("parent_count"), *(F.max(c).alias(f"__{c}") for c in columns))
    return out.select(key, "parent_count", *(F.when(F.col("parent_count") == 1, F.col(f"__{c}")).alias(c) for c in columns))


def membership(condition: Column) -> Column:
    """1, 0 or, where the condition is unknown, -1."""
    return F.when(condition, 1).when(~condition, 0).otherwise(-1)
