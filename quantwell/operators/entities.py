"""Names to entities: exact and fuzzy candidates, opaque references."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantwell.plans.errors import QueryError

#: Characters that a token has at least, if it is ASCII and if not; candidates that are shown.
LEAST_ASCII, LEAST_OTHER, CANDIDATES = 3, 2, 50


def normal(token: str) -> str:
    """NFKC, trimmed, single spaces, case-folded."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", token).strip()).casefold()


def _folded(names: pd.Series) -> pd.Series:
    return names.map(normal, na_action="ignore")


def normal_column(c: Column) -> Column:
    """The same of a column: names of ASCII alone stay in the JVM, others are normalized in Arrow batches."""
    plain = F.trim(F.lower(F.regexp_replace(c, r"[\s\x1C-\x1F]+", " ")))
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.pandas_udf(_folded, "string")(c)).otherwise(plain)


def reference(kind: Column, identity: Column) -> Column:
    """An opaque reference: a digest of the kind and the identity."""
    return F.sha2(F.concat(kind, F.lit("\0"), identity.cast("string")), 256)


def candidates(token: str, sources: Mapping[str, tuple[DataFrame, str, str]], kinds: list[str] | None = None, limit: int = CANDIDATES) -> DataFrame:
    """(entity_type, identity, name, match_rank, reference) of names equal to the token (0), beginning with it (1) or holding it (2).

    sources: entity type to (table, identity column, name column). Fuzzy matches are candidates, never bindings.
    """
    t = normal(token)
    if len(t) < (LEAST_ASCII if t.isascii() else LEAST_OTHER):
        raise QueryError("INVALID_INPUT", "the token is too short", "token")
    out = None
    for kind in kinds or sources:
        df, identity, name = sources[kind]
        n = normal_column(F.col(name))
        rank = F.when(n == t, 0).when(n.startswith(t), 1).when(n.contains(t), 2)
        one = df.select(F.lit(kind).alias("entity_type"), F.col(identity).cast("string").alias("identity"), F.col(name).alias("name"), rank.alias("match_rank")).where(F.col("match_rank").isNotNull()).distinct()
        out = one if out is None else out.unionByName(one)
    return out.withColumn("reference", reference(F.col("entity_type"), F.col("identity"))).orderBy("match_rank", "entity_type", "name", "identity").limit(limit)


def canonical(names: list[str], aliases: Mapping[str, tuple[str, ...]], master: DataFrame, identity: str, name: str) -> dict[str, tuple[str, ...]]:
    """Identities of exact names: registered aliases first (they may stand for several), then the master; else an error.

    The master is asked once for all names and answers with two rows a name at most.
    """
    found = {n: tuple(aliases[normal(n)]) for n in names if normal(n) in aliases}
    rest = {normal(n): n for n in names if n not in found}
    if rest:
        rows = master.select(normal_column(F.col(name)).alias("n"), F.col(identity).cast("string").alias("i")).where(F.col("n").isin(list(rest))).groupBy("n").agg(F.min("i").alias("a"), F.max("i").alias("b")).collect()
        for r in rows:
            if r["a"] != r["b"]:
                raise QueryError("ENTITY_AMBIGUOUS", f"{rest[r['n']]} names several", "filters")
            found[rest[r["n"]]] = (r["a"],)
    for n in names:
        if n not in found:
            raise QueryError("ENTITY_NOT_FOUND", f"nothing is named {n}", "filters")
    return found
