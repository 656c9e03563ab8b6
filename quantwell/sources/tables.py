"""Governed tables: scans of whitelisted columns, weekly freezes, pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantwell.plans.contracts import Dataset
from quantwell.plans.errors import QueryError


class Tables:
    """Parquet tables of a folder, or frames given by name; one object reads each table once."""

    def __init__(self, spark: SparkSession, folder: str | None = None, frames: Mapping[str, DataFrame] | None = None):
        self.spark, self.folder, self.frames = spark, folder, dict(frames or {})

    def raw(self, table: str) -> DataFrame:
        if table not in self.frames:
            if self.folder is None:
                raise QueryError("CONTRACT_UNAVAILABLE", f"no table {table}")
            self.frames[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self.frames[table]

    def scan(self, dataset: Dataset, columns: list[str] | None = None, *, required: bool = True) -> DataFrame:
        """Whitelisted columns of a dataset, its required filters applied; the rest is never read."""
        wanted = list(columns) if columns is not None else list(dataset.columns)
        for c in wanted:
            if c not in dataset.columns or c in dataset.blocked:
                raise QueryError("COLUMN_NOT_ALLOWED", f"{dataset.name} does not show {c}", c)
        df = self.raw(dataset.table)
        for name, expression in dataset.derived.items():
            df = df.withColumn(name, F.expr(expression))
        if required and dataset.required:
            df = df.where(reduce(lambda a, b: a & b, (f.condition() for f in dataset.required)))
        return df.select(*wanted)


def limited(df: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first `limit` rows of an order without ties, with `truncated` telling if there were more."""
    top = df.orderBy(*order).limit(limit + 1)
    more = top.agg((F.count("*") > limit).alias("truncated"))
    return top.crossJoin(F.broadcast(more)).orderBy(*order).limit(limit)  # limit + 1 rows and one row


def paged(df: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The page of `size` rows whose key follows `after`; the key is unique, so pages never overlap."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def freeze_week(rows: DataFrame, path: str, week: str) -> DataFrame:
    """Replaces one week of a table partitioned by week_label and reads that week back, checked.

    The other weeks stay as they are. Raises if what is read differs in rows or content.
    """
    seal = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    labelled = rows.withColumn("week_label", F.lit(week))
    labelled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_label").parquet(path)
    back = rows.sparkSession.read.schema(labelled.schema).parquet(path).where(F.col("week_label") == week)
    if seal(back) != seal(rows):
        raise QueryError("BASELINE_CHANGED", f"week {week} does not read back as it was written")
    return back


def observed_rows(df: DataFrame, budget: int | None = None) -> DataFrame:
    """All rows in the order of all their columns; an error if the source has more than a given `budget`.

    Without a budget the source is read whole, however large: the sort is distributed and spills.
    With one, the check reads one row beyond it; equal rows are interchangeable, so the order is total.
    """
    if budget is not None and df.limit(budget + 1).count() > budget:
        raise QueryError("SOURCE_ROW_BUDGET_EXCEEDED", f"more than {budget} rows: the old input stays")
    return df.orderBy(*df.columns)


def probed(facts: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The facts of the wanted pairs: one semi-join instead of batches of lists."""
    return facts.join(pairs.select(*keys).distinct(), keys, "left_semi")


def probed_sides(facts: DataFrame, sides: Mapping[str, tuple[DataFrame, str]], related: Column) -> DataFrame:
    """The facts of wanted pairs that are told by a rule: rows of two or more sides for which `related` holds.

    `sides` names the frame and its key for each column of the facts; `related` is a condition on
    those columns. Pairs are not formed: one semi-join for each side, on the facts that `related`
    leaves, so the work follows facts and sides, not their product. Null keys are in no pair.
    """
    found = facts.where(related)
    for column, (side, key) in sides.items():
        found = found.join(side.select(F.col(key).alias(column)), column, "left_semi")
    return found.select(*facts.columns)


class SnapshotGroup:
    """Linked reads of one state: the files of a table are fixed when it is first read.

    All reads share `marker`. After the first error the group is poisoned and reads no more.
    """

    def __init__(self, tables: Tables):
        self.tables = Tables(tables.spark, tables.folder, tables.frames)
        self.marker = uuid.uuid4().hex
        self.poisoned = False

    def run(self, query: Callable[[Tables], DataFrame]) -> DataFrame:
        if self.poisoned:
            raise QueryError("SNAPSHOT_GROUP_POISONED", "an earlier query of this group failed")
        try:
            return query(self.tables)
        except Exception:
            self.poisoned = True
            raise

    def pin(self, *names: str) -> None:
        """Fixes the files of tables; those added to the folder later are not read."""
        for name in names:
            df = self.run(lambda t, name=name: t.raw(name))
            if files := df.inputFiles():
                self.tables.frames[name] = self.tables.spark.read.schema(df.schema).parquet(*files)


class Store:
    """Named tables of a work folder: each write is a new version, and readers see whole versions only."""

    def __init__(self, spark: SparkSession, folder: str, schemas: Mapping[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), dict(schemas)

    def _path(self, table: str) -> str:
        if table not in self.schemas:
            raise QueryError("COLUMN_NOT_ALLOWED", f"no table {table} in this store", table)
        return f"{self.folder}/{table}"

    def _versions(self, table: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(path) if fs.exists(done(x.getPath(), "_SUCCESS")))

    def rows(self, table: str) -> DataFrame:
        versions = self._versions(table)
        if not versions:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(f"{self._path(table)}/v{versions[-1]}")

    def write(self, table: str, rows: DataFrame, *, expected: int | None = None) -> int:
        """Replaces a table; `expected` is the version that the writer has read, and another one is refused."""
        versions = self._versions(table)
        last = versions[-1] if versions else 0
        if expected is not None and expected != last:
            raise QueryError("REFERENCE_CHANGED", f"{table} is at version {last}, not {expected}")
        empty = self.spark.createDataFrame([], self.schemas[table])
        rows.select(*(F.col(f.name).cast(f.dataType) for f in empty.schema)).write.mode("errorifexists").parquet(f"{self._path(table)}/v{last + 1}")
        return last + 1

    def insert(self, table: str, rows: DataFrame) -> int:
        return self.write(table, self.rows(table).unionByName(rows))

    def delete(self, table: str, condition: Column) -> int:
        return self.write(table, self.rows(table).where(~F.coalesce(condition, F.lit(False))))

    def update(self, table: str, condition: Column, values: Mapping[str, Column]) -> int:
        hit = F.coalesce(condition, F.lit(False))
        df = self.rows(table)
        return self.write(table, df.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns)))
