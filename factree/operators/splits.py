"""Best splits of all nodes and features in one job.

Rows are (node, fid, kind, num, txt, s, c): sums of a node's rows by value of a feature. A feature of kind NUM is
ordered by value (num for numbers, txt for strings), LCAT by the mean of each category, CAT sets each category against the
rest. Prefix sums run within (node, feature). Nulls come last, so they go to the right; the cut behind the last value
parts them from all others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Predicate, Test, all_of
from ..plans.graph import CAT, LCAT, NUM
from ..sources.shared import scratch

#: Slices of a feature whose prefix sums are made in parts.
SLICES = 512


def gain(s: Column, c: Column, g: Column, h: Column) -> Column:
    """How much a cut into (s, c) and the rest of (g, h) lowers the squared error: (s h - c g)^2 / (c (h - c) h), 0 outside 0 < c < h.

    The same as s^2/c + (g-s)^2/(h-c) - g^2/h, without the loss of digits in its last difference."""
    s, c, g, h = (x.cast("double") for x in (s, c, g, h))
    inner = s * h - c * g
    return F.when((c > 0) & (c < h), inner * inner / (c * (h - c) * h)).otherwise(F.lit(0.0))


def criterion(s: Column, c: Column, g: Column, h: Column) -> Column:
    """s/c * s + (g-s)/(h-c) * (g-s) if c < h, else 0."""
    s, c, g, h = (x.cast("double") for x in (s, c, g, h))
    return F.when(c < h, s / c * s + (g - s) / (h - c) * (g - s)).otherwise(F.lit(0.0))


def as_number(column: str, dtype: str) -> Column | None:
    """Numbers, dates (days) and timestamps (seconds) as doubles; None for what has no number."""
    value = F.col(f"`{column}`")
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or dtype.startswith("decimal"):
        return value.cast("double")
    if dtype == "date":
        return F.unix_date(value).cast("double")
    if dtype.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("double") / 1e6
    return None


def long_form(rows: DataFrame, features: Sequence[tuple[int, str, str]], keys: Sequence[str] = ("node",)) -> DataFrame:
    """rows with s, c, keys and the features (fid, column, kind), one row per feature, summed by value."""
    types = dict(rows.dtypes)
    cells = []
    for fid, column, kind in features:
        number = as_number(column, types[column]) if kind == NUM else None
        text = F.lit(None).cast("string") if number is not None else F.col(f"`{column}`").cast("string")
        number = F.lit(None).cast("double") if number is None else number
        cells.append(F.struct(F.lit(fid).alias("fid"), F.lit(kind).alias("kind"), number.alias("num"), text.alias("txt")))
    exploded = rows.select(*keys, "s", "c", F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*", "s", "c")
    return exploded.groupBy(*keys, "fid", "kind", "num", "txt").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def prefix_sums(found: DataFrame, by: Sequence[str], order: Sequence[Column], s: str = "s", c: str = "c") -> DataFrame:
    """ps and pc, running sums by order (ties share), and g and h, the totals, within `by`."""
    running = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    columns = [F.sum(s).over(running).alias("ps"), F.sum(c).over(running).alias("pc"), F.sum(s).over(whole).alias("g"), F.sum(c).over(whole).alias("h")]
    return found.select("*", *columns)


def in_order(found: DataFrame) -> tuple[DataFrame, list[Column]]:
    """found with mean, the mean of LCAT categories, and the order of a feature's values; other strings go by themselves."""
    ordered = F.col("kind") == LCAT
    found = found.withColumn("mean", F.when(ordered, F.col("s").cast("double") / F.col("c")))
    text = F.when(~ordered, F.col("txt"))
    return found, [F.col("mean").asc_nulls_last(), F.col("num").asc_nulls_last(), text.asc_nulls_last()]


def in_slices(found: DataFrame, slices: int = SLICES, by: Sequence[str] = ("node", "fid")) -> DataFrame:
    """found as a written table with __slice, the range of all its rows in order that a row is in.

    Ranges are cut at sampled quantiles of (by, order), so they are of about equal size however values and groups are spread; ties
    share a slice. The caller releases the table."""
    rows, order = in_order(found)
    rows = rows.repartitionByRange(slices, *by, *order).withColumn("__slice", F.spark_partition_id())
    return scratch(found.sparkSession, rows.drop("mean"), "slices")


def sliced_prefix_sums(found: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Like prefix_sums, for rows of in_slices(): no task gets all rows of a group. Slices are summed with map-side combine, and only
    those sums and each slice by itself are put in order."""
    sums = found.groupBy(*by, "__slice").agg(F.sum("s").alias("__s"), F.sum("c").alias("__c"))
    before, whole = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    starts = [F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"__before_{x}") for x in "sc"]
    totals = [F.sum("__s").over(whole).alias("g"), F.sum("__c").over(whole).alias("h")]
    sums = sums.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__slice").alias("__at"), *starts, *totals)
    running = Window.partitionBy(*by, "__slice").orderBy(*order)
    rows = found.select("*", F.sum("s").over(running).alias("__ps"), F.sum("c").over(running).alias("__pc"))
    rows = rows.join(sums, all_of([*[F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by], F.col("__slice") == F.col("__at")]))
    rows = rows.withColumn("ps", F.col("__ps") + F.col("__before_s")).withColumn("pc", F.col("__pc") + F.col("__before_c"))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def curve(found: DataFrame, slices: int = 0) -> DataFrame:
    """Every possible cut with its left side (ps, pc), totals (g, h) and gain. slices: prefix sums are made in so many parts, as they
    are for rows of in_slices()."""
    if slices:
        found = in_slices(found, slices)
    found, order = in_order(found)
    make = sliced_prefix_sums if "__slice" in found.columns else prefix_sums
    sums = make(found, ["node", "fid"], order)
    alone = F.col("kind") == CAT
    sums = sums.withColumn("ps", F.when(alone, F.col("s")).otherwise(F.col("ps"))).withColumn("pc", F.when(alone, F.col("c")).otherwise(F.col("pc")))
    return sums.withColumn("gain", gain(F.col("ps"), F.col("pc"), F.col("g"), F.col("h")))


def best(found: DataFrame, slices: int = 0) -> DataFrame:
    """The best cut of each (node, fid): the greatest gain, then the least value; of LCAT features with the left set."""
    cut = F.struct((-F.col("gain")).alias("loss"), "mean", F.col("num").isNull().alias("nonum"), "num", F.col("txt").isNull().alias("notxt"), "txt", "ps", "pc", "g", "h")
    members = F.collect_list(F.when(F.col("kind") == LCAT, F.struct("mean", "txt")))
    top = curve(found, slices).groupBy("node", "fid", "kind").agg(F.min(cut).alias("b"), members.alias("members"))
    left = F.transform(F.filter("members", lambda m: m["mean"] <= F.col("b.mean")), lambda m: m["txt"])
    return top.select("node", "fid", "kind", (-F.col("b.loss")).alias("gain"), "b.num", "b.txt", "b.ps", "b.pc", "b.g", "b.h", left.alias("members"))


@dataclass(frozen=True)
class Split:
    relation: str
    feature: str
    kind: str
    gain: float
    value: object  # the threshold, the category, or the tuple of categories that go left
    left: tuple[float, float]
    total: tuple[float, float]
    temporal: str | None = None  # type of a date, timestamp or boolean feature, whose threshold is a number

    def left_predicate(self, column: Column | str) -> Predicate:
        """Rows that go left; all others, nulls among them unless they are a category, go right."""
        column = self.comparable(column)
        if self.kind == NUM:
            return Predicate(Test.NOT_GREATER, column, self.value)
        if self.kind == LCAT:
            return Predicate(Test.IN, column.cast("string"), self.value)
        return Predicate(Test.NOT_DISTINCT, column.cast("string"), self.value)

    def comparable(self, column: Column | str) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        if self.temporal == "boolean":
            return column.cast("double")
        if self.temporal == "date":
            return F.unix_date(column).cast("double")
        if self.temporal:
            return F.unix_micros(column.cast("timestamp")).cast("double") / 1e6
        return column

    def goes_left(self, column: Column | str) -> Column:
        return F.coalesce(self.left_predicate(column).column, F.lit(False))

    def text(self, left: bool) -> str:
        if self.kind == NUM:
            return f"{self.feature} <= {self.value}" if left else f"{self.feature} > {self.value} OR {self.feature} IS NULL"
        if self.kind == LCAT:
            return f"{self.feature} {'' if left else 'NOT '}IN ({', '.join(map(repr, self.value))})"
        return f"{self.feature} IS {'NOT ' if left else ''}DISTINCT FROM {self.value!r}"
