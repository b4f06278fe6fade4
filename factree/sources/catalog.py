"""Named tables of a session: registering, schemas, temporary tables and views, updates, drops and set operations."""

from __future__ import annotations

import itertools
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import all_of
from .shared import release, scratch

TEMPORARY = "factree_tmp_"


class CatalogError(Exception):
    pass


class Catalog:
    """Tables by name. Users' tables are never changed; what the engine makes begins with TEMPORARY."""

    def __init__(self, spark: SparkSession | None = None):
        spark = spark if spark is not None else SparkSession.getActiveSession()
        if not isinstance(spark, SparkSession):
            raise CatalogError(f"a SparkSession is needed, not {type(spark).__name__}")
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self._numbers, self._own = itertools.count(), uuid.uuid4().hex[:8]

    def new_name(self) -> str:
        return f"{TEMPORARY}{self._own}_{next(self._numbers)}"

    def register(self, name: str, source: object = None, replace: bool = False) -> DataFrame:
        """source: a DataFrame, a pandas frame, the path of a csv, parquet, json or orc file, or None for a table of the session.

        A name that is taken stays as it is unless replace is set. Schemas are inferred once, here."""
        if name in self.tables and not replace:
            return self.tables[name]
        if isinstance(source, DataFrame):
            found = source
        elif isinstance(source, (str, os.PathLike)):
            found = self._read(str(source))
        elif source is not None and hasattr(source, "to_dict"):
            found = self.spark.createDataFrame(source)
        elif source is None and self.spark.catalog.tableExists(name):
            found = self.spark.table(name)
        else:
            raise CatalogError(f"{name}: no such table, and nothing to read it from")
        self.tables[name] = found
        return found

    def _read(self, path: str) -> DataFrame:
        kind = path.rstrip("/").rpartition(".")[2].lower()
        if kind == "csv":
            return self.spark.read.option("header", True).option("inferSchema", True).csv(path)
        if kind in ("parquet", "json", "orc"):
            return self.spark.read.format(kind).load(path)
        raise CatalogError(f"{path}: a csv, parquet, json or orc file is needed")

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.register(name)

    def schema(self, name: str) -> list[str]:
        return self.table(name).columns

    # what a query can become: a written table, a view, rows
    def write(self, df: DataFrame) -> str:
        """A temporary table: computed once and written to the shared folder."""
        name = self.new_name()
        self.tables[name] = scratch(self.spark, df, name)
        return name

    def view(self, df: DataFrame) -> str:
        """A lazy temporary view, which SQL can name too."""
        name = self.new_name()
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return name

    @staticmethod
    def fetch(df: DataFrame) -> list[tuple]:
        """Rows as tuples; for results that are small by nature."""
        return [tuple(r) for r in df.collect()]

    def _own_only(self, name: str) -> None:
        if not name.startswith(TEMPORARY):
            raise CatalogError(f"{name} is a user's table and stays as it is")

    def drop(self, name: str) -> None:
        self._own_only(name)
        df = self.tables.pop(name, None)
        if df is not None:
            release(df)
        self.spark.catalog.dropTempView(name)

    def rename_column(self, name: str, old: str, new: str) -> None:
        self._own_only(name)
        if old not in self.schema(name):
            raise CatalogError(f"{name} has no column {old}")
        self.tables[name] = self.table(name).withColumnRenamed(old, new)

    def update(self, name: str, column: str, value: Column, conditions: list[Column] = ()) -> None:
        """column becomes value where all conditions hold: a projection, not a change in place."""
        self._own_only(name)
        value = F.when(all_of(conditions), value).otherwise(F.col(column)) if conditions else value
        self.tables[name] = self.table(name).withColumn(column, value)


def set_operation(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION, UNION ALL, INTERSECT, INTERSECT ALL, EXCEPT or EXCEPT ALL, columns by place."""
    operations = {
        "UNION": lambda: left.union(right).distinct(),
        "UNION ALL": lambda: left.union(right),
        "INTERSECT": lambda: left.intersect(right),
        "INTERSECT ALL": lambda: left.intersectAll(right),
        "EXCEPT": lambda: left.subtract(right),
        "EXCEPT ALL": lambda: left.exceptAll(right),
    }
    if kind.upper() not in operations:
        raise CatalogError(f"no set operation {kind}")
    return operations[kind.upper()]()
