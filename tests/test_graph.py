import pytest
from factree.plans.graph import GraphError, JoinGraph, walk_order
from factree.plans.models import DecisionTree, DummyModel
from fixtures import MANY_TO_MANY, ONE_TO_MANY, R, frames


def graph_of(spark, found, features, y=None):
    graph = JoinGraph.of(spark)
    for name, frame in frames(spark, found).items():
        graph.add_relation(name, features.get(name, []), "h" if name == y else None, source=frame)
    return graph


def one_to_many(spark, y="R"):
    graph = graph_of(spark, ONE_TO_MANY, {"R": ["d"], "S": ["e"], "T": ["k"]}, y)
    graph.add_join("R", "T", ["b"], ["b"])
    graph.add_join("S", "T", ["f"], ["f"])
    return graph


def counted(found, left, right, key):
    """Most rows of left for a key, and the keys of right that left lacks."""
    keys = {}
    for name in (left, right):
        schema, rows = found[name]
        at = [c.split()[0] for c in schema.split(", ")].index(key)
        keys[name] = [r[at] for r in rows]
    return max(map(keys[left].count, keys[left])), len(set(keys[right]) - set(keys[left]))


def profiled(graph, left, right):
    return graph.multiplicity(left, right), graph.missing_keys(left, right)


def test_profiles_of_one_to_many(spark):
    graph = one_to_many(spark)
    for a, b, key in (("R", "T", "b"), ("S", "T", "f")):
        assert profiled(graph, a, b) == counted(ONE_TO_MANY, a, b, key) and profiled(graph, b, a) == counted(ONE_TO_MANY, b, a, key)
    assert graph.multiplicity("S", "T", simple=True) == "M" and graph.multiplicity("T", "S", simple=True) == "1"


def test_profiles_of_many_to_many(spark):
    graph = graph_of(spark, MANY_TO_MANY, {})
    graph.add_join("R", "S", ["b"], ["b"])
    graph.add_join("S", "T", ["b"], ["b"])
    for a, b in (("R", "S"), ("S", "T")):
        assert profiled(graph, a, b) == counted(MANY_TO_MANY, a, b, "b") and profiled(graph, b, a) == counted(MANY_TO_MANY, b, a, "b")


def test_profiles_count_null_and_composite_keys(spark):
    left = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    right = spark.createDataFrame([(1, None, 5), (3, "y", 6)], "x int, y string, z int")
    graph = JoinGraph.of(spark)
    graph.add_relation("l", source=left)
    graph.add_relation("r", ["z"], source=right)
    graph.add_join("l", "r", ["a", "b"], ["x", "y"])
    assert (graph.multiplicity("l", "r"), graph.multiplicity("r", "l"), graph.missing_keys("l", "r"), graph.missing_keys("r", "l")) == (2, 1, 1, 1)


def test_bad_graphs(spark):
    graph = graph_of(spark, ONE_TO_MANY, {})
    with pytest.raises(GraphError):
        graph.add_relation("U", ["nothing"], source=frames(spark, {"R": R})["R"])
    with pytest.raises(GraphError):
        graph.add_relation("R")
    with pytest.raises(GraphError):
        graph.add_join("R", "T", ["b"], ["b", "f"])
    with pytest.raises(GraphError):
        graph.add_join("R", "X", ["b"], ["b"])
    with pytest.raises(GraphError, match="not joined"):
        graph.check()
    graph.add_join("R", "T", ["b"], ["b"])
    graph.add_join("S", "T", ["f"], ["f"])
    with pytest.raises(GraphError, match="no target"):
        graph.check()
    graph.add_join("R", "S", ["a"], ["f"], profile=False)
    with pytest.raises(GraphError, match="cycle"):
        graph.check_acyclic()


def test_facts(spark):
    with pytest.raises(GraphError):
        DummyModel().fit(one_to_many(spark))  # S is not functional behind T
    assert DecisionTree(max_depth=2).fit(one_to_many(spark), strict=False).trees  # only the target's neighbours are looked at
    missing = frames(spark, {"R": ("a int, b int, h double", [(1, 1, 1.0), (4, 3, 2.0)]), "S": ("b int, e int", [(1, 2), (2, 1)])})
    graph = JoinGraph.of(spark)
    graph.add_relation("R", [], "h", source=missing["R"])
    graph.add_relation("S", ["e"], source=missing["S"])
    graph.add_join("R", "S", ["b"], ["b"])
    with pytest.raises(GraphError, match="lacks 1"):
        graph.check()


def test_unused_keys_of_a_dimension_are_fine(spark):
    found = frames(spark, {"R": ("a int, b int, h double", [(1, 1, 1.0), (4, 2, 2.0)]), "S": ("b int, e int", [(1, 2), (2, 1), (3, 1)])})
    graph = JoinGraph.of(spark)
    graph.add_relation("R", [], "h", source=found["R"])
    graph.add_relation("S", ["e"], source=found["S"])
    graph.add_join("R", "S", ["b"], ["b"])
    graph.check()


def test_walks():
    assert walk_order({"R": {"S": 0}, "S": {"R": 0, "T": 0}, "T": {"S": 0}}) == (["R", "S", "T"], [("R", "S"), ("S", "T")])
    tree = {"A": ["B", "C"], "B": ["A", "D", "E"], "C": ["A", "F", "G"], "D": ["B"], "E": ["B"], "F": ["C"], "G": ["C"]}
    nodes, edges = walk_order({k: dict.fromkeys(v) for k, v in tree.items()})
    assert nodes == ["D", "B", "A", "C", "F", "G", "E"]
    assert edges == [("D", "B"), ("B", "A"), ("A", "C"), ("C", "F"), ("C", "G"), ("B", "E")]


def test_changes_and_pictures(spark):
    graph = one_to_many(spark)
    copy = graph.copy()
    copy.replace("T", "T2")
    copy.catalog.register("T2", graph.table("T"))
    assert copy.has_join("R", "T2") and not copy.has_join("R", "T") and graph.has_join("R", "T")
    assert copy.path("R", "S") == ["R", "T2", "S"]
    copy.replace_attribute("T2", "f", "g")
    assert copy.join_keys("S", "T2") == (("f",), ("g",))
    found = graph.as_dict()
    assert [n["id"] for n in found["nodes"]] == ["R", "S", "T"] and len(found["links"]) == 2
    assert "<svg" in graph._repr_html_() and "http" not in graph._repr_html_()
    assert graph.base_relations() == ["S", "T"] and graph.useful_columns("T") == ["k", "b", "f"]
    assert graph.full_join().count() == 2 * 0 + 2 * 3 + 1 * 3  # rows of R with b = 1, 2, 3 by rows of S that their T meets
