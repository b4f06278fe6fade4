"""Aggregates over all rows up to a place in their order, without a task that gets all rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import Expression, Op, all_of
from ..sources.shared import scratch


def running(rows: DataFrame, out: Mapping[str, Expression], order: Sequence[str]) -> DataFrame:
    """out, its aggregates each over the rows up to a row's place by order (nulls last; ties share a place).

    Rows are summed by place with map-side combine, so a place that very many rows share is no hot group. Places are cut into
    sampled ranges and written; running sums are made in each range, and a range begins with the sums of those before it, one row
    for each. Rows then meet their place by a join. A distinct count adds one at each value's first place."""
    by = [f"__by{k}" for k in range(len(order))]
    inputs = [(e.taken_of if e.is_aggregate else e.column).alias(f"__x{k}") for k, e in enumerate(out.values())]
    rows = rows.select(*[F.col(c).alias(b) for c, b in zip(order, by, strict=True)], *inputs)
    aggregates = {f"__x{k}": e.op for k, e in enumerate(out.values()) if e.is_aggregate}
    counted = [x for x, op in aggregates.items() if op is Op.DISTINCT_COUNT]
    all_rows = rows.withColumns({x: F.lit(0).cast("long") for x in counted}) if counted else rows
    for x in counted:
        all_rows = all_rows.unionByName(_firsts(rows, x, by), allowMissingColumns=True)
    parts = {f"{x}_{k}": part for x, op in aggregates.items() for k, part in enumerate(_parts(op, x, dict(rows.dtypes)[x]))}
    places = all_rows.groupBy(*by).agg(*[first.alias(name) for name, (first, _) in parts.items()])

    ascending = [F.col(b).asc_nulls_last() for b in by]
    places = places.repartitionByRange(*ascending).withColumn("__range", F.spark_partition_id())
    places = scratch(rows.sparkSession, places, "places")
    types = dict(places.dtypes)
    up_to = Window.partitionBy("__range").orderBy(*ascending).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = places.groupBy(F.col("__range").alias("__at")).agg(*[again(name).alias(name) for name, (_, again) in parts.items()])
    starts = ranges.select("__at", *[again(name).over(before).cast(types[name]).alias(f"{name}_before") for name, (_, again) in parts.items()])
    here = places.select(*by, "__range", *[again(name).over(up_to).cast(types[name]).alias(name) for name, (_, again) in parts.items()])
    here = here.join(starts, F.col("__range") == F.col("__at"))
    both = {name: _both(again, F.col(name), F.col(f"{name}_before")) for name, (_, again) in parts.items()}
    results = here.select(
        *[F.col(b).alias(f"{b}_there") for b in by],
        *[_result(op, x, both, rows).alias(f"{x}_result") for x, op in aggregates.items()],
    )
    found = rows.join(results, all_of([F.col(b).eqNullSafe(F.col(f"{b}_there")) for b in by]))
    return found.select(*[F.col(f"__x{k}_result" if e.is_aggregate else f"__x{k}").alias(n) for k, (n, e) in enumerate(out.items())])


def _firsts(rows: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """A row with x = 1 at the first place of each value of x."""
    place = F.struct(*[c for b in by for c in (F.col(b).isNull().alias(f"{b}_null"), F.col(b))])
    found = rows.filter(F.col(x).isNotNull()).groupBy(x).agg(F.min(place).alias("at"))
    return found.select(*[F.col(f"at.{b}").alias(b) for b in by], F.lit(1).cast("long").alias(x))


def _parts(op: Op, x: str, dtype: str) -> list[tuple[Column, Callable[[str], Column]]]:
    """What a place holds of an aggregate, and how that is aggregated again."""
    if op in (Op.MIN, Op.MAX):
        again = F.min if op is Op.MIN else F.max
        return [(again(x), again)]
    if op is Op.COUNT:
        return [(F.count(x), F.sum)]
    if op is Op.AVG:
        value = F.col(x) if dtype.startswith("decimal") else F.col(x).cast("double")
        return [(F.sum(value), F.sum), (F.count(x), F.sum)]
    return [(F.sum(x), F.sum)]


def _both(again: Callable[[str], Column], here: Column, before: Column) -> Column:
    if again is F.sum:
        return F.coalesce(before + here, here, before)
    return F.least(before, here) if again is F.min else F.greatest(before, here)


def _result(op: Op, x: str, both: Mapping[str, Column], rows: DataFrame) -> Column:
    if op is Op.AVG:
        return F.try_divide(both[f"{x}_0"], both[f"{x}_1"]).cast(rows.agg(F.avg(x)).dtypes[0][1])
    return both[f"{x}_0"]
