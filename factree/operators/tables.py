"""Operators on single tables that users need besides aggregates: long form, numbering and tops of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def melt(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """keys, name, value: a row for each row and column; the columns take their common type."""
    return rows.unpivot(list(keys), list(columns), name, value).select(*keys, name, value)


def numbered_within(rows: DataFrame, by: Sequence[str], order: Sequence, name: str = "at") -> DataFrame:
    """rows with their place, from 0, within their group. A group is put in order by one task."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def top_of_each(rows: DataFrame, by: Sequence[str], value: str, ties: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """by and columns of the row with the greatest value (a number) in each group, of equal ones that with the least ties.

    An aggregate with map-side combine: no group is sorted or gathered."""
    best = F.min_by(F.struct(*columns), F.struct(F.col(value).isNull(), -F.col(value), *ties)).alias("__top")
    return rows.groupBy(*by).agg(best).select(*by, "__top.*")
