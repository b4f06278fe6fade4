"""Semi-rings whose values annotate rows: (sum, count) pairs, added along unions and multiplied along joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import all_of


@dataclass(frozen=True)
class Variance:
    """A pair on the driver: s, the sum of targets or gradients, and c, the number of rows."""

    s: float = 0.0
    c: float = 0.0

    def __add__(self, other: Variance) -> Variance:
        return Variance(self.s + other.s, self.c + other.c)

    def __sub__(self, other: Variance) -> Variance:
        return Variance(self.s - other.s, self.c - other.c)

    def __mul__(self, other: Variance) -> Variance:
        return Variance(self.s * other.c + self.c * other.s, self.c * other.c)

    @property
    def mean(self) -> float:
        return self.s / self.c if self.c else 0.0

    # the same on columns s and c
    @staticmethod
    def lift(value: Column) -> list[Column]:
        return [value.alias("s"), F.lit(1).cast("long").alias("c")]

    @staticmethod
    def sums(s: str = "s", c: str = "c") -> list[Column]:
        return [F.sum(s).alias("s"), F.sum(c).alias("c")]

    @staticmethod
    def product(left: tuple[Column, Column], right: tuple[Column, Column]) -> tuple[Column, Column]:
        (s1, c1), (s2, c2) = left, right
        return s1 * c2 + c1 * s2, c1 * c2


@dataclass(frozen=True)
class Average:
    """Sum, count and average of one measure over a join of many tables, each table summed by itself first.

    tables: alias -> DataFrame; measure: (alias, column). A table's rows get (measure, 1) if it holds the measure, else (0, 1)."""

    measure: tuple[str, str]
    keys: tuple[str, ...] = ()

    def lift(self, alias: str, table: DataFrame) -> DataFrame:
        value = F.col(self.measure[1]) if alias == self.measure[0] else F.lit(0)
        return table.select(*self.keys, value.alias("s"), F.lit(1).cast("long").alias("c"))

    def partial(self, alias: str, table: DataFrame) -> DataFrame:
        """(s, c) by key: what the others need to know of a table."""
        return self.lift(alias, table).groupBy(*self.keys).agg(*Variance.sums())

    def sum_over_product(self, tables: dict[str, DataFrame]) -> DataFrame:
        """s = sum of each s_i times all other c_j, c = product of all c: over the join on keys without making it."""
        parts = {a: self.partial(a, t).alias(a) for a, t in tables.items()}
        names = list(parts)
        joined = parts[names[0]]
        for a in names[1:]:
            on = [F.col(f"{names[0]}.{k}").eqNullSafe(F.col(f"{a}.{k}")) for k in self.keys]
            joined = joined.join(parts[a], all_of(on), "inner")
        pairs = [(F.col(f"{a}.s"), F.col(f"{a}.c")) for a in names]
        s, c = reduce(Variance.product, pairs)
        return joined.agg(F.coalesce(F.sum(s), F.lit(0)).alias("s"), F.coalesce(F.sum(c), F.lit(0)).alias("c"))

    @staticmethod
    def column_sum(table: DataFrame, column: str) -> DataFrame:
        return table.agg(F.sum(column).alias("s"), F.count("*").alias("c"))

    @staticmethod
    def ratio(total: DataFrame) -> DataFrame:
        return total.select(F.try_divide(F.col("s").cast("double"), F.col("c").cast("double")).alias("avg"))


def totals(rows: DataFrame, s: str = "s", c: str = "c") -> Variance:
    row = rows.agg(F.sum(s).cast("double").alias("s"), F.sum(c).alias("c")).first()
    return Variance(row["s"] or 0.0, row["c"] or 0)

