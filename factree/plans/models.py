"""Models over join graphs: a constant, one tree, boosted trees, a forest."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import all_of
from ..operators.semiring import Variance, totals
from ..operators.trees import GROWTHS, Grower, Node, leaves, prediction
from ..sources.shared import release, scratch
from .graph import GraphError, JoinGraph
from .rename import free_name, without_reserved

FULL_JOIN_JG, FULL_JOIN_DF, JOIN_GRAPH = "FULL_JOIN_JG", "FULL_JOIN_DF", "JOIN_GRAPH"


class DummyModel:
    """The mean of the target."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.constant, self.count, self.trees = 0.0, 0, []
        self.target = self.target_relation = None
        self.names: dict[tuple[str, str], str] = {}

    def fit(self, graph: JoinGraph, strict: bool = True) -> DummyModel:
        """strict: see JoinGraph.check. The graph stays as it is; a second call forgets the first.

        Rows whose target is null have nothing to teach and are left out, as by AVG; predictions are made for them too."""
        self.reset()
        graph.check(strict)
        graph = graph.copy()
        self.target, self.target_relation = graph.target, graph.target_relation
        self._fit(graph)
        return self

    def _fit(self, graph: JoinGraph) -> None:
        y = F.col(f"`{graph.target}`").cast("double")
        total = totals(graph.table(graph.target_relation).filter(y.isNotNull()).select(y.alias("s"), F.lit(1).alias("c")))
        self.constant, self.count = total.mean, total.c

    # scoring
    def column(self, qualified: bool = False, find=None) -> Column:
        """The prediction as a column over a join; features are named feature, or relation.feature if qualified."""
        find = find or (lambda r, f: F.col(f"`{r}.{f}`" if qualified else f"`{f}`"))
        out = F.lit(float(self.constant))
        for root, rate in self.trees:
            out = out + prediction(root, rate, lambda r, f: find(r, self.names.get((r, f), f)))
        return out

    def predict(self, data: JoinGraph | DataFrame, input_mode: str = JOIN_GRAPH, output_mode: str = "DATAFRAME", qualified: bool = False):
        """input_mode: JOIN_GRAPH joins the graph's relations (every row of the target's relation gets a prediction), FULL_JOIN_JG takes the graph's target relation as the full join,
        FULL_JOIN_DF takes a DataFrame. output_mode: DATAFRAME (lazy), NUMPY (in the order of the target's rows) or
        WRITE_TO_TABLE (the name of a written table with the columns prediction and target)."""
        order = None
        if input_mode == JOIN_GRAPH:
            rows, order = self._joined(data)
            score = self.column(find=lambda r, f: F.col(f"`{r}.{f}`"))
            target = F.col(f"`{data.target_relation}.{data.target}`") if data.target else None
        elif input_mode == FULL_JOIN_JG:
            rows, score = data.table(data.target_relation), self.column(qualified)
            target = F.col(f"`{data.target}`") if data.target else None
        elif input_mode == FULL_JOIN_DF:
            rows, score = data, self.column(qualified)
            target = F.col(f"`{self.target}`") if self.target in data.columns else None
        else:
            raise ValueError(f"no input mode {input_mode}")
        if output_mode == "NUMPY":
            if order is None:
                order = "__row"
                rows = rows.withColumn(order, F.monotonically_increasing_id())
            found = rows.select(score.alias("prediction"), F.col(f"`{order}`").alias("__order")).toPandas().sort_values("__order", kind="stable")
            return found["prediction"].to_numpy()
        out = rows.select(score.alias("prediction"), *([target.alias(self.target)] if target is not None else []))
        if output_mode == "WRITE_TO_TABLE":
            if isinstance(data, DataFrame):
                raise ValueError("a written table needs a graph and its catalog")
            return data.catalog.write(out)
        if output_mode != "DATAFRAME":
            raise ValueError(f"no output mode {output_mode}")
        return out

    @staticmethod
    def _joined(graph: JoinGraph) -> tuple[DataFrame, str]:
        """The full join of a graph, with its target's rows numbered by a column that no feature is called."""
        numbered = graph.copy()
        target = graph.target_relation
        order = free_name("row_id", graph.table(target).columns)
        spark = graph.catalog.spark
        rows = scratch(spark, graph.table(target).select(*graph.useful_columns(target), F.monotonically_increasing_id().alias(order)), "numbered")
        numbered.features[target] = dict(numbered.features[target]) | {order: "NUM"}
        return _full_join(numbered, {target: rows}), f"{target}.{order}"

    def rmse(self, rows: DataFrame, target: str | None = None, qualified: bool = False) -> DataFrame:
        """One row, rmse, over a full join."""
        target = target or self.target
        y = F.col(f"`{self.target_relation}.{target}`" if qualified else f"`{target}`").cast("double")
        return rows.agg(F.sqrt(F.avg(F.pow(y - self.column(qualified), F.lit(2)))).alias("rmse"))

    def compute_rmse(self, rows: DataFrame, target: str | None = None, qualified: bool = False) -> list[float]:
        return [self.rmse(rows, target, qualified).first()["rmse"]]

    # looking at the model
    def rules(self) -> list[list[tuple[float, list[str]]]]:
        """For each tree its leaves: what they add and the conditions in words."""
        out = []
        for root, rate in self.trees:
            found = [(n.total.mean * rate, [s.text(left) for s, left in n.path()]) for n in leaves(root)]
            out.append([] if root.children is None else found)
        return out

    def save(self) -> str:
        """The model as JSON; load() makes a model of it that scores alike."""

        def node(n: Node) -> dict:
            out: dict = {"mean": n.total.mean, "count": n.total.c}
            if n.children:
                s = n.found
                out |= {"relation": s.relation, "feature": s.feature, "kind": s.kind, "value": s.value, "gain": s.gain, "temporal": s.temporal}
                out["children"] = [node(c) for c in n.children]
            return out

        names = [[*k, v] for k, v in self.names.items()]
        return json.dumps({"constant": self.constant, "count": self.count, "target": [self.target_relation, self.target], "names": names, "trees": [[rate, node(r)] for r, rate in self.trees]})


def load(text: str) -> DummyModel:
    from ..operators.splits import Split

    def node(found: dict, parent: Node | None = None, is_left: bool = True) -> Node:
        n = Node(0, parent.depth + 1 if parent else 0, Variance(found["mean"] * found["count"], found["count"]), parent, is_left)
        if "children" in found:
            value = tuple(found["value"]) if isinstance(found["value"], list) else found["value"]
            n.found = Split(found["relation"], found["feature"], found["kind"], found["gain"], value, (0, 0), (0, 0), found["temporal"])
            n.children = tuple(node(c, n, k == 0) for k, c in enumerate(found["children"]))
        return n

    data, model = json.loads(text), DummyModel()
    model.constant, model.count = data["constant"], data["count"]
    model.target_relation, model.target = data["target"]
    model.names = {(r, f): old for r, f, old in data["names"]}
    model.trees = [(node(t), rate) for rate, t in data["trees"]]
    return model


def _full_join(graph: JoinGraph, frames: dict[str, DataFrame]) -> DataFrame:
    kept = {name: graph.catalog.tables.get(name) for name in frames}
    graph.catalog.tables.update(frames)
    try:
        return graph.full_join(qualified=True, how="left")
    finally:
        graph.catalog.tables.update({n: f for n, f in kept.items() if f is not None})


@dataclass
class _Options:
    num_leaves: int = 31
    learning_rate: float = 1.0
    max_depth: int = 6
    subsample: float = 1.0
    growth: str = "bestfirst"
    seed: int = 0

    def check(self) -> None:
        if self.num_leaves < 1 or self.max_depth < 0:
            raise ValueError("num_leaves must be 1 or more and max_depth 0 or more")
        if not 0 < self.subsample <= 1 or self.learning_rate <= 0:
            raise ValueError("subsample must be in (0, 1] and learning_rate above 0")
        if self.growth not in GROWTHS:
            raise ValueError(f"growth must be one of {', '.join(GROWTHS)}")


@dataclass
class _Lifted:
    """The target's table ready for training: s, c, node, keys and features."""

    graph: JoinGraph
    rows: DataFrame
    mean: float
    total: Variance
    local: dict[str, str] = field(default_factory=dict)


class DecisionTree(DummyModel):
    """A regression tree. growth: bestfirst (greatest gain next), depthwise (stack) or levelwise (queue); num_leaves bounds the leaves.

    debug, partition_early and enable_batch_optimization are taken by all models and change nothing: the fact is always
    partitioned by a column (its rows' tree node), and the splits of all nodes and features are always found in one job."""

    def __init__(
        self, num_leaves: int = 31, learning_rate: float = 1, max_depth: int = 6, subsample: float = 1, growth: str = "bestfirst",
        debug: bool = False, partition_early: bool = True, enable_batch_optimization: bool = False, seed: int = 0,
    ):
        self.options = _Options(num_leaves, learning_rate, max_depth, subsample, growth, seed)
        self.options.check()
        super().__init__()

    def _fit(self, graph: JoinGraph) -> None:
        lifted = self._lift(graph, self.options.subsample, self.options.seed)
        self.constant, self.count = lifted.mean, lifted.total.c
        release(self._train(lifted, self.options.learning_rate, rows_needed=False).base, lifted.rows)

    def _lift(self, graph: JoinGraph, subsample: float, seed: int) -> _Lifted:
        """Samples rows, subtracts their mean, and leaves no column called like the engine's own."""
        graph, self.names = without_reserved(graph)
        target = graph.target_relation
        rows = graph.table(target)
        if subsample < 1:
            rows = scratch(graph.catalog.spark, rows.sample(withReplacement=False, fraction=subsample, seed=seed), "sample")
        y = F.col(f"`{graph.target}`").cast("double")
        rows = rows.filter(y.isNotNull())
        total = totals(rows.select(y.alias("s"), F.lit(1).alias("c")))
        if not total.c:
            raise GraphError("there is no row to learn from")
        columns = [c for c in graph.useful_columns(target) if c != graph.target or c in [*graph.keys_of(target), *graph.features[target]]]
        rows = rows.select((y - F.lit(total.mean)).alias("s"), F.lit(1).cast("long").alias("c"), *[F.col(f"`{c}`") for c in columns])
        # along joins that are not N:1 a row counts once for each partner: only those relations are joined
        local: dict[str, str] = {}
        for a, b in graph.not_functional():
            edge, prefix = graph.edges[a][b], f"{b}__"
            there = graph.table(b).select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in graph.useful_columns(b)])
            for r in graph.path(target, a)[1:]:  # a itself must be at hand
                if r not in local:
                    local[r] = f"{r}__"
                    before = graph.path(target, r)[-2]
                    rows = self._with_relation(rows, graph, before, r, local)
            on = [F.col(f"`{local.get(a, '')}{x}`").eqNullSafe(F.col(f"`{prefix}{y}`")) for x, y in zip(edge.left_keys, edge.right_keys, strict=True)]
            rows = rows.join(there, all_of(on), "inner")
            local[b] = prefix
        rows = scratch(graph.catalog.spark, rows.withColumn("node", F.lit(0)), "lifted")
        return _Lifted(graph, rows, total.mean, totals(rows), local)

    @staticmethod
    def _with_relation(rows: DataFrame, graph: JoinGraph, before: str, name: str, local: dict[str, str]) -> DataFrame:
        edge = graph.edges[before][name]
        there = graph.table(name).select(*[F.col(f"`{c}`").alias(f"{name}__{c}") for c in graph.useful_columns(name)])
        on = [F.col(f"`{local.get(before, '')}{x}`").eqNullSafe(F.col(f"`{name}__{y}`")) for x, y in zip(edge.left_keys, edge.right_keys, strict=True)]
        return rows.join(there, all_of(on), "inner")

    def _train(self, lifted: _Lifted, rate: float, rows_needed: bool = True) -> Grower:
        """Adds a tree; the grower's fact has each row's leaf in node, if that is needed."""
        o = self.options
        grower = Grower(lifted.graph, lifted.rows, o.num_leaves, o.max_depth, o.growth, lifted.local, rows_needed=rows_needed)
        root = grower.grow(lifted.total)
        self.trees.append((root, rate))
        return grower


class GradientBoosting(DecisionTree):
    """Trees one after the other, each on what the others left."""

    def __init__(
        self, num_leaves: int = 31, learning_rate: float = 1, max_depth: int = 6, n_estimators: int = 1,
        debug: bool = False, partition_early: bool = False, enable_batch_optimization: bool = False, growth: str = "bestfirst", seed: int = 0,
    ):
        super().__init__(num_leaves, learning_rate, max_depth, 1, growth, debug, partition_early, enable_batch_optimization, seed)
        self.n_estimators = n_estimators

    def _fit(self, graph: JoinGraph) -> None:
        lifted = self._lift(graph, 1, self.options.seed)
        self.constant, self.count = lifted.mean, lifted.total.c
        for k in range(self.n_estimators):
            grower = self._train(lifted, self.options.learning_rate, rows_needed=k + 1 < self.n_estimators)
            if k + 1 < self.n_estimators:
                before = lifted.rows
                lifted.rows = scratch(lifted.graph.catalog.spark, self.residuals(grower.fact, *self.trees[-1]), "residuals")
                release(before, grower.base)
                lifted.total = totals(lifted.rows)

    @staticmethod
    def residuals(rows: DataFrame, root: Node, rate: float) -> DataFrame:
        """s less what the rows' leaves predict; all rows back in node 0."""
        if root.children is None:
            return rows
        value: Column | None = None
        for n in leaves(root):
            here = F.lit(float(n.total.mean * rate))
            own = F.col("node").isin(n.number, *n.below)
            value = F.when(own, here) if value is None else value.when(own, here)
        return rows.withColumn("s", F.col("s") - value.otherwise(F.lit(0.0))).withColumn("node", F.lit(0))


class RandomForest(DecisionTree):
    """The average of trees on samples of the rows; the constant is the average of the samples' means."""

    def __init__(
        self, num_leaves: int = 31, learning_rate: float = 1, max_depth: int = 6, subsample: float = 1, n_estimators: int = 1,
        debug: bool = False, partition_early: bool = False, enable_batch_optimization: bool = False, growth: str = "bestfirst", seed: int = 0,
    ):
        super().__init__(num_leaves, 1 / n_estimators, max_depth, subsample, growth, debug, partition_early, enable_batch_optimization, seed)
        self.n_estimators = n_estimators

    def _fit(self, graph: JoinGraph) -> None:
        means = []
        for k in range(self.n_estimators):
            lifted = self._lift(graph, self.options.subsample, self.options.seed + k)
            means.append(lifted.mean)
            self.count = lifted.total.c
            release(self._train(lifted, 1 / self.n_estimators, rows_needed=False).base, lifted.rows)
        self.constant = sum(means) / len(means)
