import json
import random

import numpy as np
import pytest
from factree.operators import splits, trees
from factree.operators.messages import Kind, MessageTree
from factree.operators.semiring import Variance
from factree.plans.graph import GraphError, JoinGraph
from factree.plans.models import FULL_JOIN_DF, FULL_JOIN_JG, DecisionTree, DummyModel, GradientBoosting, RandomForest, load
from factree.plans.rename import free_name, history, without_reserved
from factree.sources.shared import scratch
from factree.streaming.scoring import score
from pyspark.sql import functions as F


def star(spark, rows=400, seed=1, nulls=False, reserved=False):
    pick = random.Random(seed)
    s = [(a, pick.randint(1, 300)) for a in range(1, 41)]
    t = [(b, pick.randint(1, 900), pick.choice(["x", "y", "z", None])) for b in range(1, 31)]
    r = []
    for k in range(rows):
        a, b, d = pick.randint(1, 40), pick.randint(1, 30), pick.randint(1, 200)
        r.append((k, a, b, None if nulls and k % 7 == 0 else float(d), float(a * a - b * d + s[a - 1][1])))
    d, h = ("c", "s") if reserved else ("d", "h")
    graph = JoinGraph.of(spark)
    graph.add_relation("R", [d], h, source=spark.createDataFrame(r, f"id int, a int, b int, {d} double, {h} double"))
    graph.add_relation("S", ["a", "e"], source=spark.createDataFrame(s, "a int, e int"))
    graph.add_relation("T", ["f"], categorical=["g"], source=spark.createDataFrame(t, "b int, f int, g string"))
    graph.add_join("R", "S", ["a"], ["a"])
    graph.add_join("R", "T", ["b"], ["b"])
    return graph


def plain_tree(x, y, depth):
    """Predictions of a greedy tree on numbers."""
    out = np.full(len(y), y.mean())
    if depth == 0 or len(y) < 2:
        return out
    best, cut = 1e-9, None
    g, h = (y - y.mean()).sum(), len(y)
    for k in range(x.shape[1]):
        for v in np.unique(x[:, k])[:-1]:
            left = x[:, k] <= v
            s, c = (y - y.mean())[left].sum(), left.sum()
            gain = (s * h - c * g) ** 2 / (c * (h - c) * h)
            if gain > best * (1 + 1e-12):
                best, cut = gain, left
    if cut is None:
        return out
    out[cut], out[~cut] = plain_tree(x[cut], y[cut], depth - 1), plain_tree(x[~cut], y[~cut], depth - 1)
    return out


def numbers(graph):
    rows = graph.full_join(qualified=True).toPandas().sort_values("R.id") if "id" in graph.features["R"] else graph.full_join(qualified=True).toPandas()
    return rows[["R.d", "S.a", "S.e", "T.f"]].to_numpy(dtype=float), rows["R.h"].to_numpy()


def test_a_tree_equals_a_plain_tree_on_the_join(spark):
    graph = star(spark)
    graph.features["T"].pop("g")
    x, y = numbers(graph)
    model = DecisionTree(max_depth=3, num_leaves=8).fit(graph)
    want = plain_tree(x, y, 3)
    assert model.compute_rmse(graph.full_join())[0] == pytest.approx(np.sqrt(((y - want) ** 2).mean()), abs=1e-6)
    got = graph.full_join().select(model.column().alias("p")).toPandas()["p"].to_numpy()
    assert np.sort(got) == pytest.approx(np.sort(want), abs=1e-6)


def test_boosting_equals_plain_boosting(spark):
    graph = star(spark, rows=250, seed=3)
    graph.features["T"].pop("g")
    x, y = numbers(graph)
    left, want = y - y.mean(), np.full(len(y), y.mean())
    for _ in range(3):
        step = 0.5 * plain_tree(x, left, 2)
        want, left = want + step, left - step
    model = GradientBoosting(max_depth=2, learning_rate=0.5, n_estimators=3).fit(graph)
    assert model.compute_rmse(graph.full_join())[0] == pytest.approx(np.sqrt(((y - want) ** 2).mean()), abs=1e-5)


@pytest.mark.parametrize("growth", ["bestfirst", "depthwise", "levelwise"])
def test_growths_and_leaf_limits(spark, growth):
    graph = star(spark)
    model = DecisionTree(max_depth=4, num_leaves=5, growth=growth).fit(graph)
    rules = model.rules()[0]
    assert len(rules) == 5 and all(len(path) <= 4 for _, path in rules)
    assert model.compute_rmse(graph.full_join())[0] < DummyModel().fit(graph).compute_rmse(graph.full_join())[0]


def test_counts_of_leaves_match_their_conditions(spark):
    """A split on the target's table, then ones on others: rows must meet all of them."""
    graph = star(spark, nulls=True)
    model = DecisionTree(max_depth=3).fit(graph)
    rows = graph.full_join()
    by_prediction = {round(r["p"], 6): (r["n"], r["m"]) for r in rows.groupBy(F.round(model.column(), 6).alias("p")).agg(F.count("*").alias("n"), F.avg("h").alias("m")).collect()}
    for p, (_, mean) in by_prediction.items():
        assert p == pytest.approx(mean, abs=1e-4)
    assert sum(n for n, _ in by_prediction.values()) == 400


def test_reserved_names_change_nothing(spark):
    one, two = star(spark), star(spark, reserved=True)
    a = DecisionTree(max_depth=3).fit(one).compute_rmse(one.full_join())[0]
    model = DecisionTree(max_depth=3).fit(two)
    assert model.compute_rmse(two.full_join())[0] == pytest.approx(a, abs=1e-9)
    assert two.features["R"] == {"c": "NUM"} and two.target == "s"
    back = without_reserved(two)[1]
    assert {(x["new"], x["old"]) for x in json.loads(history(back))} == {("reserved_c", "c"), ("reserved_s", "s")}
    assert free_name("s", ["S", "reserved_s"]) == "reserved_reserved_s"


def test_ways_to_predict(spark):
    graph = star(spark)
    model = DecisionTree(max_depth=2).fit(graph)
    rows = graph.full_join()
    graph.catalog.register("joined", rows)
    whole = JoinGraph(graph.catalog)
    whole.add_relation("joined", [], "h")
    n = lambda df: sorted(round(r["prediction"], 6) for r in df.select("prediction").collect())
    want = n(model.predict(graph))
    assert n(model.predict(whole, FULL_JOIN_JG)) == want == n(model.predict(rows, FULL_JOIN_DF)) == n(score(rows, model))
    assert n(graph.catalog.table(model.predict(graph, output_mode="WRITE_TO_TABLE"))) == want
    assert sorted(np.round(model.predict(graph, output_mode="NUMPY"), 6)) == want
    table = graph.table("R").withColumnRenamed("id", "rowid")
    graph.catalog.tables["R"] = table
    assert len(model.predict(graph, output_mode="NUMPY")) == 400
    for bad in ({"input_mode": "x"}, {"output_mode": "x"}):
        with pytest.raises(ValueError):
            model.predict(graph, **bad)


def test_numpy_predictions_come_in_the_order_of_the_rows(spark):
    graph = star(spark)
    model = DecisionTree(max_depth=3).fit(graph)
    rows = graph.full_join(qualified=False)
    by_row = {}
    ids = graph.table("R").select("id", "a", "b", "d").toPandas()
    for r in rows.select("a", "b", "d", model.column().alias("p")).collect():
        by_row[r["a"], r["b"], r["d"]] = r["p"]
    want = [by_row[r.a, r.b, r.d] for r in ids.itertuples()]
    assert model.predict(graph, output_mode="NUMPY") == pytest.approx(want)


def test_saved_models_score_alike(spark):
    graph = star(spark, nulls=True)
    model = GradientBoosting(max_depth=2, n_estimators=2, learning_rate=0.3).fit(graph)
    rows = graph.full_join()
    assert load(model.save()).compute_rmse(rows, "h")[0] == pytest.approx(model.compute_rmse(rows)[0])


def test_a_forest_of_whole_samples_is_its_tree(spark):
    graph = star(spark)
    rows = graph.full_join()
    one = DecisionTree(max_depth=3).fit(graph).compute_rmse(rows)[0]
    assert RandomForest(max_depth=3, n_estimators=3).fit(graph).compute_rmse(rows)[0] == pytest.approx(one, abs=1e-6)
    assert RandomForest(max_depth=3, n_estimators=3, subsample=0.6).fit(graph).compute_rmse(rows)[0] != pytest.approx(one, abs=1e-9)


def test_no_features_and_no_gain_give_the_mean(spark):
    graph = JoinGraph.of(spark)
    graph.add_relation("R", [], "h", source=spark.createDataFrame([(1.0,), (3.0,)], "h double"))
    model = DecisionTree().fit(graph)
    assert model.constant == 2.0 and model.rules() == [[]] and model.compute_rmse(graph.table("R")) == [1.0]
    assert model.fit(graph).rules() == [[]]  # a second fit forgets the first
    none = JoinGraph.of(spark)
    none.add_relation("R", [], "h", source=spark.createDataFrame([], "h double"))
    with pytest.raises(GraphError):
        DecisionTree().fit(none)


def test_one_vs_rest_strings_dates_and_nulls(spark):
    rows = [(c, "m" if k % 2 else "n", f"2020-01-{k + 1:02d}", 10.0 if c == "b" else 1.0 + k / 100) for k, c in enumerate(["a", "b", None, "b", "c", "b", "a", None])]
    frame = spark.createDataFrame(rows, "c1 string, c2 string, day string, y double").withColumn("day", F.to_date("day"))
    graph = JoinGraph.of(spark)
    graph.add_relation("R", ["c2", "day"], "y", one_vs_rest=["c1"], source=frame)
    model = DecisionTree(max_depth=1, num_leaves=2).fit(graph)
    assert sorted(round(v + model.constant, 4) for v, _ in model.rules()[0]) == [pytest.approx((1.0 + 1.02 + 1.04 + 1.06 + 1.07) / 5, abs=1e-4), 10.0]
    graph.features["R"] = {"day": "NUM", "c2": "NUM"}
    model = DecisionTree(max_depth=3).fit(graph)
    assert model.compute_rmse(frame)[0] < DummyModel().fit(graph).compute_rmse(frame)[0]


def test_options_are_checked():
    for bad in ({"num_leaves": 0}, {"max_depth": -1}, {"subsample": 0}, {"learning_rate": 0}, {"growth": "other"}):
        with pytest.raises(ValueError):
            DecisionTree(**bad)


def test_messages_of_random_predicates_equal_the_join(spark):
    graph = star(spark, rows=200, seed=9)
    rows = graph.full_join(qualified=True)
    for k, (d, e, f) in enumerate([(100, 150, 450), (50, 290, 100), (190, 20, 800)]):
        tree = MessageTree(graph, semi_join=bool(k % 2))
        tree.lift()
        tree.add_predicates("R", [F.col("d") <= d])
        tree.add_predicates("S", [F.col("e") <= e])
        tree.add_predicates("T", [F.col("f") > f])
        tree.calibrate()
        kept = rows.filter((F.col("`R.d`") <= d) & (F.col("`S.e`") <= e) & (F.col("`T.f`") > f))
        for relation, column in (("T", "g"), ("S", "e"), ("R", "d")):
            got = {r[column]: (r["s"], r["c"]) for r in tree.absorb(relation, [column]).collect()}
            want = {r["v"]: (r["s"], r["c"]) for r in kept.groupBy(F.col(f"`{relation}.{column}`").alias("v")).agg(F.sum("`R.h`").alias("s"), F.count("*").alias("c")).collect()}
            assert got == want
        assert tree.partition_target("S").join(graph.table("T").filter(F.col("f") > f), "b").count() == kept.count()
        assert tree.partition_target("R") is None
        tree.clean()
        assert not tree.messages


def test_plain_dimensions_send_nothing(spark):
    tree = MessageTree(star(spark))
    tree.lift()
    tree.calibrate()
    assert {tree.messages[x, "R"].kind for x in ("S", "T")} == {Kind.SELECTION, Kind.IDENTITY} or tree.messages["S", "R"].kind is Kind.IDENTITY
    assert tree.messages["R", "S"].kind is Kind.FULL
    child = tree.copy(Variance(1.0, 2))
    child.add_predicates("S", ["e > 10"])
    assert "S" not in tree.predicates and child.total.mean == 0.5


def test_semiring_laws():
    a, b, c = Variance(2, 3), Variance(5, 1), Variance(-1, 4)
    assert (a + b) - b == a and a * b == b * a and a * (b + c) == a * b + a * c
    assert Variance().mean == 0


def test_streams_are_scored(spark, tmp_path):
    graph = star(spark)
    model = DecisionTree(max_depth=2).fit(graph)
    rows = graph.full_join()
    rows.write.parquet(str(tmp_path / "in"))
    stream = score(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), model)
    query = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").count() == 400
    assert {round(r[0], 6) for r in spark.table("scored").select("prediction").collect()} == {round(r[0], 6) for r in rows.select(model.column()).collect()}


@pytest.mark.parametrize("growth", ["bestfirst", "depthwise", "levelwise"])
def test_splitting_ahead_changes_nothing(spark, growth, monkeypatch):
    graph = star(spark, rows=200)
    options = {"max_depth": 4, "num_leaves": 6, "learning_rate": 0.5, "n_estimators": 2, "growth": growth}
    one = GradientBoosting(**options).fit(graph)
    monkeypatch.setattr(trees, "AHEAD", 0)
    two = GradientBoosting(**options).fit(graph)
    flat = lambda m: sorted((round(v, 6), tuple(path)) for rules in m.rules() for v, path in rules)
    assert flat(one) == flat(two) and len(one.rules()[0]) == 6


def test_writing_the_routed_fact_changes_nothing(spark, monkeypatch):
    graph = star(spark, rows=200)
    options = {"max_depth": 3, "num_leaves": 6, "learning_rate": 0.5, "n_estimators": 2}
    flat = lambda m: sorted((round(v, 6), tuple(path)) for rules in m.rules() for v, path in rules)
    lazy = flat(GradientBoosting(**options).fit(graph))
    monkeypatch.setattr(trees, "PENDING", 0)  # after each level
    assert flat(GradientBoosting(**options).fit(graph)) == lazy
    monkeypatch.setattr(trees, "PENDING", 2)  # after some
    monkeypatch.setattr(trees, "too_large", lambda rows: "e" in str(rows.columns))
    assert flat(GradientBoosting(**options).fit(graph)) == lazy


def test_sliced_prefix_sums_equal_whole_ones(spark):
    graph = star(spark, rows=300, nulls=True)
    tree = MessageTree(graph)
    fact = tree.lift().withColumn("node", F.expr("CAST(pmod(hash(a, b, d), 3) AS int)"))
    found = scratch(spark, trees.Grower(graph, fact).statistics(), "statistics")
    rounded = lambda df: sorted(((*r[:3], *(round(x, 4) if isinstance(x, float) else x for x in r[3:])) for r in df.select("node", "fid", "num", "txt", "ps", "pc", "g", "h", "gain").collect()), key=repr)
    for slices in (1, 7, 512):
        assert rounded(splits.curve(found, slices)) == rounded(splits.curve(found))


def test_constructors_take_the_options_that_change_nothing(spark):
    graph = JoinGraph.of(spark)
    graph.add_relation("r", ["flag"], "y", source=spark.createDataFrame([(True, 1.0), (True, 3.0), (False, 8.0), (None, 9.0), (False, None)], "flag boolean, y double"))
    for model in (DecisionTree(4, 1, 2, 1, "bestfirst", True, True, True), GradientBoosting(4, 1, 2, 1, debug=True, partition_early=True), RandomForest(max_depth=2, enable_batch_optimization=True)):
        model.fit(graph)
        assert model.constant == 5.25 and model.count == 4
        found = sorted(r[0] for r in model.predict(graph).select("prediction").collect())
        assert found == pytest.approx([2.0, 2.0, 8.0, 8.0, 9.0])


def test_every_row_of_the_target_is_predicted(spark):
    graph = JoinGraph.of(spark)
    graph.add_relation("r", ["a"], "y", source=spark.createDataFrame([(1, 1, 1.0), (2, None, 3.0), (3, 7, 8.0)], "a int, k int, y double"))
    model = DummyModel().fit(graph)
    graph.add_relation("d", ["b"], source=spark.createDataFrame([(1, 5), (None, 6)], "k int, b int"))
    graph.add_join("r", "d", ["k"], ["k"])
    assert model.predict(graph).count() == 3 and graph.full_join().count() == 2


def test_renames_can_be_replayed(spark):
    from factree.plans.rename import replay

    graph = JoinGraph.of(spark)
    graph.add_relation("r", ["s"], "c", source=spark.createDataFrame([(1, 2.0)], "s int, c double"))
    renamed, back = without_reserved(graph)
    again = replay(graph, history(back))
    assert again.features == renamed.features and again.table("r").columns == renamed.table("r").columns
    assert replay(again, history(back)).table("r").columns == renamed.table("r").columns and graph.table("r").columns == ["s", "c"]
    with pytest.raises(GraphError):
        replay(graph, '[{"relation": "q", "old": "a", "new": "b"}]')
