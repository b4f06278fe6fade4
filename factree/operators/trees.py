"""Growing one regression tree over a join graph, all open nodes of a step in one job.

The target's table carries s (residual), c and node, the tree node of each row (an expression over the table as last
written). A step sums (node, key) on the way to
each relation with features, joins the sums with that relation, puts all features in long form and finds the
best cut of every node and feature at once: the number of jobs depends on the depth, not on nodes or features. Since a row's node is
carried along, no predicate is applied again on other relations. The full join is never built: a relation meets
sums by its key, and rows that have moved learn their side by a join with the keys that go left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Predicate, all_of
from ..plans.graph import LCAT, NUM, JoinGraph
from ..sources.shared import release, scratch
from .semiring import Variance
from .splits import SLICES, Split, best, in_slices, long_form

GROWTHS = ("bestfirst", "depthwise", "levelwise")
#: Most nodes of a level that is split ahead.
AHEAD = 1024
#: Splits after which the fact is written with its new nodes.
PENDING = 64
#: Rows of a node from which on its features' prefix sums are made in slices.
MANY = 20_000_000


@dataclass
class Node:
    number: int
    depth: int
    total: Variance
    parent: Node | None = None
    is_left: bool = True
    found: Split | None = None  # the best split
    children: tuple[Node, Node] | None = None
    below: tuple[int, ...] = ()  # numbers of nodes that were cut below this leaf

    def cut(self) -> None:
        if self.children:
            for c in self.children:
                c.cut()
            self.below = tuple(x for c in self.children for x in (c.number, *c.below))
            self.children = None

    @property
    def gain(self) -> float:
        return self.found.gain if self.found else 0.0

    def path(self) -> list[tuple[Split, bool]]:
        return [] if self.parent is None else [*self.parent.path(), (self.parent.found, self.is_left)]


@dataclass
class Grower:
    """graph: checked; fact: the target's relation as s, c, node, row keys and features (see models); both are read many times."""

    graph: JoinGraph
    fact: DataFrame
    num_leaves: int = 31
    max_depth: int = 6
    growth: str = "bestfirst"
    local: dict[str, str] = field(default_factory=dict)  # relation -> prefix of its features on the fact itself
    number: int = 0
    rows_needed: bool = True  # that fact tells each row's leaf in the end
    base: DataFrame = field(init=False)  # the fact as last written
    pending: list[Node] = field(default_factory=list)  # split nodes whose numbers rows of base still have
    routed: bool = False  # base is this grower's own: the next writing may delete it

    def __post_init__(self) -> None:
        self.base = self.fact

    def grow(self, total: Variance) -> Node:
        """A node's best split does not depend on the order in which nodes are split, so whole levels are split first, one
        job each, and the growth then chooses among them. Only trees that could have more than AHEAD nodes on a level are
        grown a split at a time."""
        root = Node(0, 0, total)
        self.number = 1
        self._evaluate([root])
        ahead = 2**self.max_depth <= AHEAD
        if ahead:
            level = [root]
            while level := [n for n in level if n.gain > 0]:
                children = [c for n in level for c in self._split(n)]
                if self.rows_needed or children[0].depth < self.max_depth:
                    self._route(level)
                self._evaluate(children)
                level = children
        self._choose(root, ahead)
        return root

    def _choose(self, root: Node, ahead: bool) -> None:
        """Splits nodes in the order of the growth until there are num_leaves leaves; what was split ahead and not chosen is cut."""
        order, count = 0, 1
        waiting: list = []

        def push(node: Node) -> None:
            nonlocal order
            order += 1
            key = {"bestfirst": (-node.gain, node.depth, node.number), "depthwise": (-order, 0, 0), "levelwise": (order, 0, 0)}[self.growth]
            heapq.heappush(waiting, (key, node))

        push(root)
        while waiting:
            node = heapq.heappop(waiting)[1]
            if node.gain <= 0 or count >= self.num_leaves:
                node.cut()
                continue
            if not ahead:
                self._split(node)
                self._route([node])
                self._evaluate(node.children)
            count += 1
            for child in node.children:
                push(child)

    def _split(self, node: Node) -> tuple[Node, Node]:
        left = Variance(*node.found.left)
        made = []
        for total, is_left in ((left, True), (node.total - left, False)):
            made.append(Node(self.number, node.depth + 1, total, node, is_left))
            self.number += 1
        node.children = (made[0], made[1])
        return node.children

    # finding splits
    def features(self) -> list[tuple[int, str, str, str]]:
        return [(k, r, f, kind) for k, (r, f, kind) in enumerate(self.graph.all_features())]

    def _evaluate(self, nodes: Sequence[Node]) -> None:
        nodes = [n for n in nodes if n.depth < self.max_depth and n.total.c > 1]
        features = self.features()
        if not nodes or not features:
            return
        by_number = {n.number: n for n in nodes}
        statistics = self.statistics(list(by_number))
        if max(n.total.c for n in nodes) > MANY:
            statistics = in_slices(statistics, SLICES)
            rows = best(statistics).collect()
            release(statistics)
        else:
            rows = best(statistics).collect()
        names = {k: (r, f, kind) for k, r, f, kind in features}
        for r in sorted(rows, key=lambda r: (r["node"], r["fid"])):
            node = by_number[r["node"]]
            if r["gain"] is None or not r["gain"] > node.gain:
                continue
            relation, feature, kind = names[r["fid"]]
            dtype = dict(self.graph.table(relation).dtypes)[feature]
            temporal = dtype if kind == NUM and (dtype in ("date", "boolean") or dtype.startswith("timestamp")) else None
            value = r["num"] if kind == NUM and r["num"] is not None else r["txt"]
            if kind == LCAT:
                value = tuple(sorted(r["members"], key=lambda x: (x is None, x)))
            node.found = Split(relation, feature, kind, r["gain"], value, (r["ps"], r["pc"]), (r["g"], r["h"]), temporal)

    def statistics(self, numbers: Sequence[int] | None = None) -> DataFrame:
        """(node, fid, kind, num, txt, s, c) for the given nodes and all features."""
        fact = self.fact if numbers is None else self.fact.filter(F.col("node").isin(list(numbers)))
        features, target = self.features(), self.graph.target_relation
        own = [(k, self.local.get(r, "") + f, kind) for k, r, f, kind in features if r == target or r in self.local]
        parts = [long_form(fact, own)] if own else []
        sums = {target: fact}
        for parent, child in self.graph.outward():
            if child in self.local:
                sums[child] = fact
                continue
            if not self._needed(child):
                continue
            edge = self.graph.edges[parent][child]
            prefix = self.local.get(parent, "")
            keys = [F.col(f"`{prefix}{k}`").alias(f"__k{i}") for i, k in enumerate(edge.left_keys)]
            message = sums[parent].select("node", *keys, "s", "c").groupBy("node", *[f"__k{i}" for i in range(len(keys))]).agg(*Variance.sums())
            there = self.graph.table(child).select(*[F.col(f"`{c}`") for c in self.graph.useful_columns(child)])
            on = [F.col(f"__k{i}").eqNullSafe(F.col(f"`{k}`")) for i, k in enumerate(edge.right_keys)]
            sums[child] = message.join(there, all_of(on), "inner")
            found = [(k, f, kind) for k, r, f, kind in features if r == child]
            if found:
                parts.append(long_form(sums[child], found))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows

    def _needed(self, relation: str) -> bool:
        """Some relation at or behind it has features."""
        path = [relation]
        behind: dict[str, list[str]] = {}
        for a, b in self.graph.outward():
            behind.setdefault(a, []).append(b)
        while path:
            at = path.pop()
            if self.graph.features[at]:
                return True
            path += behind.get(at, [])
        return False

    # moving rows
    def _route(self, batch: Sequence[Node]) -> None:
        """Rows of split nodes get the number of the child on their side.

        The fact is not written for that: node becomes an expression over the last written fact, so a level costs no more than
        broadcast joins with the relations that were split. It is written after PENDING splits, which keeps the expression
        short, and when a split relation is too large for a broadcast, since every reader would shuffle the fact to meet it."""
        self.pending += batch
        self.fact, large = self._routed()
        if large or len(self.pending) > PENDING:
            before, self.base = self.base, scratch(self.graph.catalog.spark, self.fact, "routed")
            if self.routed:
                release(before)
            self.fact, self.routed, self.pending = self.base, True, []

    def _routed(self) -> tuple[DataFrame, bool]:
        """The base with each row's node after the pending splits, and whether it meets a relation too large for a broadcast.

        All splits of one relation reach the fact by one join: its rows, with a flag for each split, are joined hop by hop. Keys
        are unique on the way, so nothing is summed and a key that very many rows of the fact have can be split."""
        fact, large = self.base, False
        split = {n.number: n for n in self.pending}
        remote: dict[str, list[Node]] = {}
        for n in self.pending:
            if n.found.relation != self.graph.target_relation and n.found.relation not in self.local:
                remote.setdefault(n.found.relation, []).append(n)
        for relation, nodes in remote.items():
            flags = [n.found.goes_left(F.col(f"`{n.found.feature}`")).alias(f"__left{n.number}") for n in nodes]
            large = large or too_large(self.graph.table(relation).select(*flags))
            fact = self._with_flags(fact, relation, flags, [f"__left{n.number}" for n in nodes])

        def place(n: Node) -> Column:
            if n.number not in split:
                return F.lit(n.number)
            if n.found.relation in remote:
                left = F.coalesce(F.col(f"__left{n.number}"), F.lit(False))
            else:
                left = n.found.goes_left(F.col(f"`{self.local.get(n.found.relation, '')}{n.found.feature}`"))
            one, two = n.children
            return F.when(left, place(one)).otherwise(place(two))

        node = F.col("node")
        side: Column | None = None
        for n in self.pending:
            if n.parent is None or n.parent.number not in split:
                side = F.when(node == n.number, place(n)) if side is None else side.when(node == n.number, place(n))
        kept = [F.col(f"`{c}`") for c in self.base.columns if c != "node"]
        return fact.select(*kept, side.otherwise(node).alias("node")), large

    def _with_flags(self, fact: DataFrame, relation: str, flags: Sequence[Column], names: Sequence[str]) -> DataFrame:
        """fact with the flags of the row of relation that each of its rows reaches; null if it reaches none."""
        graph, path = self.graph, self.graph.path(self.graph.target_relation, relation)
        start = max(i for i, r in enumerate(path) if r in self.local or i == 0)
        rows, shown = graph.table(relation), list(flags)
        for place in range(len(path) - 1, start, -1):
            here, there = path[place], path[place - 1]
            edge = graph.edges[there][here]
            rows = rows.select(*[F.col(f"`{k}`").alias(f"__{here}_k{i}") for i, k in enumerate(edge.right_keys)], *shown)
            shown = [F.col(f"`{n}`") for n in names]
            prefix = self.local.get(there, "") if place - 1 == start else ""
            on = [F.col(f"`{prefix}{k}`").eqNullSafe(F.col(f"`__{here}_k{i}`")) for i, k in enumerate(edge.left_keys)]
            if place - 1 == start:
                return fact.join(rows, all_of(on), "left")
            rows = graph.table(there).join(rows, all_of(on), "inner")
        raise AssertionError("a relation away from the fact has a path to it")


def too_large(rows: DataFrame) -> bool:
    """Catalyst estimates more bytes than it would broadcast by itself."""
    most = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most


def leaves(root: Node) -> list[Node]:
    return [root] if root.children is None else [x for c in root.children for x in leaves(c)]


def leaf_predicates(node: Node) -> list[tuple[str, Predicate | Column]]:
    """relation and condition of each split on the way to a leaf."""
    return [(s.relation, s.left_predicate(s.feature) if left else ~s.goes_left(s.feature)) for s, left in node.path()]


def prediction(root: Node, rate: float, column) -> Column:
    """The tree as nested CASE WHEN; column(relation, feature) finds a feature."""
    if root.children is None:
        return F.lit(float(root.total.mean * rate)) if root.parent is not None else F.lit(0.0)
    left, right = (prediction(c, rate, column) for c in root.children)
    return F.when(root.found.goes_left(column(root.found.relation, root.found.feature)), left).otherwise(right)
