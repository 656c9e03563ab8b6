"""Price observations, their classes, changes between two of them, freezes and coverage plans."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantwell.operators.compare import latest
from quantwell.operators.joins import align


def observe(pool: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each product's latest quotes: of its region first, of its organisation otherwise; ties stay, products without a quote too.

    pool: product, region, organisation; quotes: product, place, price, modified, quote_id.
    """
    q = quotes.select(F.col("product").alias("__p"), "place", "price", "modified", "quote_id")
    own = (F.col("product") == F.col("__p")) & ((F.col("place") == F.col("region")) | (F.col("place") == F.col("organisation")))
    found = pool.join(q, own, "left").withColumn("priority", F.when(F.col("place") == F.col("region"), 1).when(F.col("place").isNotNull(), 2)).drop("__p")
    return latest(found, ["product", "region"], [F.col("priority").asc_nulls_last(), F.col("modified").desc_nulls_last()])


def classify(observed: DataFrame, on: date) -> DataFrame:
    """One row a (product, region): a class, and the price where it is comparable.

    observed has also valid_from and valid_to (both days included; null is open).
    """
    today = F.lit(on)
    grouped = observed.groupBy("product", "region").agg(F.count("quote_id").alias("n"), F.count_distinct("price").alias("prices"), F.max("price").alias("price"), F.max("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"))
    kind = (
        F.when(F.col("n") == 0, "missing_identity_or_quote").when(F.col("n") > 1, "ambiguous_latest").when(F.col("price").isNull(), "missing_price").when(F.col("price") < 0, "negative_price")
        .when(F.col("valid_from") > F.col("valid_to"), "invalid_validity").when(F.col("valid_from") > today, "not_yet_effective").when(F.col("valid_to") < today, "expired")
        .when(F.col("valid_to") == today, "validity_boundary").when(F.col("valid_from").isNull() & F.col("valid_to").isNull(), "unknown_validity").otherwise("comparable")
    )
    return grouped.select("product", "region", kind.alias("price_class"), F.when(F.col("n") == 1, F.col("price")).alias("price"))


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Events between two classified observations, by (product, region); those without a change are left out."""
    keys = ["product", "region"]
    a = previous.select(*keys, F.col("price").alias("old_price"), F.col("price_class").alias("old_class"))
    b = current.select(*keys, F.col("price").alias("new_price"), F.col("price_class").alias("new_class"))
    both = a.join(b, keys, "full_outer")
    old, new = F.col("old_class") == "comparable", F.col("new_class") == "comparable"
    event = (
        F.when(F.col("old_class").isNull(), "added").when(F.col("new_class").isNull(), "removed").when(~old & new, "became_comparable").when(old & ~new, "no_longer_comparable")
        .when(~old & ~new, F.when(F.col("old_class") == F.col("new_class"), "still_not_comparable").otherwise("reason_changed"))
        .when(F.col("new_price") > F.col("old_price"), "increased").when(F.col("new_price") < F.col("old_price"), "decreased").otherwise("unchanged")
    )
    return both.withColumn("event", event)


def presence(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """new, still or absent for each key of two sets."""
    a, b = previous.select(key).distinct().withColumn("was", F.lit(True)), current.select(key).distinct().withColumn("is", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "absent").otherwise("still").alias("event"))


def freeze_plan(source: DataFrame, whitelist: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Rows to freeze, and one row of issues: null identities, null units, repeated ids; any issue blocks."""
    kept = source.join(whitelist.select("item").distinct(), "item", "left_anti").where(F.col("quantity") > threshold)
    issues = kept.agg(F.count_if(F.col("item").isNull() | F.col("id").isNull()).alias("missing_identity"), F.count_if(F.col("unit").isNull()).alias("missing_unit"), (F.count("id") - F.count_distinct("id")).alias("repeated_ids"), F.count("*").alias("rows"))
    return kept, issues.withColumn("blocked", (F.col("missing_identity") + F.col("missing_unit") + F.col("repeated_ids")) > 0)


def contact_plan(tasks: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers to contact for each product in a region, with the reason where one can't be; and products without any.

    tasks: product, region; relations: product, region, customer, blocked, owner.
    """
    keys = ["product", "region"]
    plan = tasks.distinct().join(relations, keys)
    reason = F.when(F.col("customer").isNull(), "unknown_customer").when(F.col("blocked"), "blocked_customer").when(F.col("owner").isNull(), "no_owner").otherwise("ready")
    return plan.withColumn("reason", reason), tasks.distinct().join(relations, keys, "left_anti")


def continued(reference: DataFrame, current: DataFrame, keys: list[str], price: str, basis: str) -> DataFrame:
    """How each key's reference price goes on: keys, old_price, new_price, event, continuation.

    A key that is gone is removed only if every current row has a whole key, else its absence isn't
    proven. Several current rows, an unknown basis or price, or a basis that differs from the
    recorded one keep the old reference (or leave a new key pending). Otherwise the reference
    advances: unchanged, changed, new, or recovered where the old price was unknown.
    """
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    proof = current.agg((F.count_if(~whole) == 0).alias("__whole"))  # one row
    old = reference.select(*keys, F.col(price).alias("old_price"), F.col(basis).alias("__old_basis"), F.lit(True).alias("__old"))
    new = current.where(whole).groupBy(*keys).agg(F.count("*").alias("__n"), F.max(price).alias("new_price"), F.max(basis).alias("__basis"))
    both = align(old, new, keys).crossJoin(F.broadcast(proof))
    known = F.col("__old").isNotNull()
    event = (
        F.when(F.col("__n").isNull(), F.when(F.col("__whole"), "absent").otherwise("absence_not_proven")).when(F.col("__n") > 1, "ambiguous")
        .when(F.col("__basis").isNull(), "basis_missing").when(F.col("new_price").isNull(), "price_missing").when(~known, "new").when(F.col("old_price").isNull(), "recovered")
        .when(F.col("__old_basis") != F.col("__basis"), "basis_changed").when(F.col("old_price") != F.col("new_price"), "changed").otherwise("unchanged")
    )
    out = both.withColumn("event", event)
    goes_on = F.col("event").isin("new", "recovered", "changed", "unchanged")
    state = F.when(F.col("event") == "absent", "remove").when(goes_on, "advance").when(known, "retain").otherwise("pending")
    return out.select(*keys, "old_price", F.when(F.coalesce(F.col("__n") == 1, F.lit(False)), F.col("new_price")).alias("new_price"), "event", state.alias("continuation"))
