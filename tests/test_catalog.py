import pandas as pd
import pytest
from factree.functions.expressions import Attribute, Expression, Op, Predicate, Test, case
from factree.plans.query import Query, QueryError, run
from factree.sources.catalog import Catalog, CatalogError, set_operation
from pyspark.sql import functions as F


@pytest.fixture
def tables(spark):
    out = Catalog(spark)
    out.register("t", spark.createDataFrame([(1, "a", 2.0), (1, None, 4.0), (2, "b", None)], "k int, v string, x double"))
    out.register("u", spark.createDataFrame([(1, 10), (3, 30)], "k int, w int"))
    return out


def test_sources(spark, tmp_path):
    tables = Catalog(spark)
    pd.DataFrame({"a": [1, 2], "b": ["x", "y"]}).to_csv(tmp_path / "f.csv", index=False)
    assert tables.register("csv", str(tmp_path / "f.csv")).dtypes == [("a", "int"), ("b", "string")]
    tables.table("csv").write.parquet(str(tmp_path / "f.parquet"))
    tables.table("csv").write.json(str(tmp_path / "f.json"))
    tables.table("csv").write.orc(str(tmp_path / "f.orc"))
    for kind in ("parquet", "json", "orc"):
        assert tables.register(kind, str(tmp_path / f"f.{kind}")).count() == 2
    assert tables.register("pandas", pd.DataFrame({"z": [1.5]})).columns == ["z"]
    assert tables.register("csv", pd.DataFrame({"other": [1]})).columns == ["a", "b"]  # a taken name stays
    assert tables.register("csv", pd.DataFrame({"other": [1]}), replace=True).columns == ["other"]
    spark.range(3).createOrReplaceTempView("session_table")
    assert tables.schema("session_table") == ["id"]
    for bad in (None, "x.txt", 5):
        with pytest.raises(CatalogError):
            tables.register("none_such", bad)
    with pytest.raises(CatalogError):
        Catalog("no session")


def test_temporary_tables(tables):
    name = tables.write(tables.table("t"))
    tables.update(name, "x", F.lit(0.0), [F.col("k") == 1, F.col("v").isNull()])
    assert sorted(map(tuple, tables.table(name).select("k", "x").collect()), key=repr) == [(1, 0.0), (1, 2.0), (2, None)]
    tables.rename_column(name, "x", "y")
    assert tables.schema(name) == ["k", "v", "y"]
    tables.drop(name)
    for change in (lambda: tables.drop("t"), lambda: tables.update("t", "x", F.lit(1)), lambda: tables.rename_column("t", "x", "y"), lambda: tables.table(name)):
        with pytest.raises(CatalogError):
            change()


def test_null_safe_joins_and_modes(tables):
    on = [(Attribute("t", "k"), Attribute("u", "k"))]
    query = Query({"v": Attribute("t", "v"), "w": Attribute("u", "w")}, ["t", "u"], on, order_by=[("v", "asc")])
    assert run(query, tables) == [("a", 10), (None, 10)]
    assert tables.table(run(query, tables, "write")).count() == 2
    assert run(query, tables, "nested").count() == 2
    with pytest.raises(QueryError):
        run(query, tables, "other")
    with pytest.raises(QueryError):
        run(Query(tables=["t", "u"]), tables)
    with pytest.raises(QueryError):
        Query({"v": "v", "n": Expression(Op.COUNT, "*")}, ["t"], group_by=["k"]).compile(tables)
    assert run(Query(tables=["t"], where=[Predicate(Test.SEMI_JOIN, ["k"], ("u", ["k"]))]), tables, "nested").count() == 2


def test_null_members(tables):
    t = tables.table("t")
    members = lambda test, values: t.filter(Predicate(test, "v", values).column).count()
    assert [members(Test.IN, ["a", None]), members(Test.NOT_IN, ["a", None]), members(Test.IN, []), members(Test.NOT_IN, ["a"])] == [2, 1, 0, 2]


def test_division_and_cases(tables):
    row = tables.table("t").select(Expression(Op.DIV, ["k", "k - 1"]).column.alias("d"), case([]).alias("z"), case([("k", ["k > 1"])]).alias("c")).orderBy("k").collect()
    assert [tuple(r) for r in row] == [(None, 0.0, 0.0), (None, 0.0, 0.0), (2.0, 0.0, 2.0)]
    assert Attribute("t", "k") == "k" and Attribute("t", "k") != Attribute("u", "k")


def test_no_other_set_operation(tables):
    with pytest.raises(CatalogError):
        set_operation("XOR", tables.table("t"), tables.table("t"))
