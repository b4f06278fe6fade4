import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from factree.functions.expressions import Expression, Op
from factree.plans.query import Query, run
from factree.sources.catalog import Catalog


def test_running_aggregates_equal_one_window(spark):
    dice = random.Random(7)
    pick = lambda *values: dice.choice([None, *values])
    data = [(k, pick(1, 2, 3, 4), pick("a", "b"), pick(*range(9)), pick(0.5, 2.0)) for k in range(300)] + [(300 + k, 2, "b", 5, 1.0) for k in range(200)]
    frames = {"r": spark.createDataFrame(data, "id long, a int, b string, x int, y double"), "none": spark.createDataFrame([], "id long, a int, b string, x int, y double")}
    window = Window.orderBy(F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    aggregates = {
        "s": (Expression(Op.SUM, "x"), F.sum("x")),
        "n": (Expression(Op.COUNT, "*"), F.count("*")),
        "nx": (Expression(Op.COUNT, "x"), F.count("x")),
        "nxy": (Expression(Op.COUNT, ["x", "y"]), F.count(F.col("x") + F.col("y"))),
        "d": (Expression(Op.DISTINCT_COUNT, "x"), F.size(F.collect_set("x"))),
        "e": (Expression(Op.DISTINCT_COUNT, "b"), F.size(F.collect_set("b"))),
        "low": (Expression(Op.MIN, "y"), F.min("y")),
        "high": (Expression(Op.MAX, "x"), F.max("x")),
        "mean": (Expression(Op.AVG, "x"), F.avg("x")),
        "xy": (Expression(Op.SUM_PROD, ["x", "y"]), F.sum(F.col("x") * F.col("y"))),
    }
    for rows in frames.values():
        catalog = Catalog(spark)
        query = Query({"id": "id", **{n: e for n, (e, _) in aggregates.items()}}, {"r": rows}, window_by=["a", "b"])
        found = run(query, catalog, "nested")
        cells = [(F.size(F.collect_set("x" if n == "d" else "b").over(window)) if n in "de" else c.over(window)).alias(n) for n, (_, c) in aggregates.items()]
        wanted = rows.select("id", *cells)
        flat = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert flat(found) == flat(wanted)
