"""Join graphs: relations with features, a target and the keys that join them."""

from __future__ import annotations

import copy
import html
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import all_of
from ..sources.catalog import Catalog

#: Feature kinds: ordered by value, ordered by the mean target of a category, one category against the rest.
NUM, LCAT, CAT = "NUM", "LCAT", "CAT"


class GraphError(Exception):
    pass


@dataclass
class Edge:
    """One direction of a join. multiplicity: most rows of `left` for a key. missing: keys of `right` that left lacks.

    Both are None until the edge is profiled."""

    left: str
    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    multiplicity: int | None = None
    missing: int | None = None


@dataclass
class JoinGraph:
    catalog: Catalog
    features: dict[str, dict[str, str]] = field(default_factory=dict)  # relation -> feature -> kind
    edges: dict[str, dict[str, Edge]] = field(default_factory=dict)
    target: str | None = None
    target_relation: str | None = None

    @classmethod
    def of(cls, source: SparkSession | Catalog | None = None) -> JoinGraph:
        return cls(source if isinstance(source, Catalog) else Catalog(source))

    def copy(self) -> JoinGraph:
        return JoinGraph(self.catalog, copy.deepcopy(self.features), copy.deepcopy(self.edges), self.target, self.target_relation)

    # relations
    def add_relation(self, name: str, X: Sequence[str] = (), y: str | None = None, categorical: Sequence[str] = (), one_vs_rest: Sequence[str] = (), source: object = None, replace: bool = False) -> None:
        """X are features ordered by value, categorical ones are split into sets, one_vs_rest into a category and the others.

        A graph has one target; the last one given counts. Adding a relation anew drops its joins."""
        if name in self.features and not replace:
            raise GraphError(f"{name} is in the graph already")
        self.catalog.register(name, source, replace=replace and source is not None)
        kinds = {**dict.fromkeys(X, NUM), **dict.fromkeys(categorical, LCAT), **dict.fromkeys(one_vs_rest, CAT)}
        self._check_columns(name, [*kinds, *([y] if y else [])])
        for other in self.edges.pop(name, {}):
            self.edges[other].pop(name, None)
        self.features[name], self.edges[name] = kinds, {}
        if y:
            self.target, self.target_relation = y, name

    def _check_columns(self, name: str, columns: Sequence[str]) -> None:
        lacking = set(columns) - set(self.catalog.schema(name))
        if lacking:
            raise GraphError(f"{name} has no column {', '.join(sorted(lacking))}")

    def add_join(self, left: str, right: str, left_keys: Sequence[str], right_keys: Sequence[str], profile: bool = True) -> None:
        if len(left_keys) != len(right_keys) or not left_keys:
            raise GraphError("a join needs as many keys on the left as on the right")
        for name, keys in ((left, left_keys), (right, right_keys)):
            if name not in self.features:
                raise GraphError(f"{name} is not in the graph")
            self._check_columns(name, keys)
        self.edges[left][right] = Edge(left, right, tuple(left_keys), tuple(right_keys))
        self.edges[right][left] = Edge(right, left, tuple(right_keys), tuple(left_keys))
        if profile:
            self.profile(left, right)

    def profile(self, left: str, right: str) -> None:
        """Counts rows by key on both sides and compares the keys; nulls are keys too."""
        self.profile_all([(left, right)])

    def profile_all(self, pairs: Sequence[tuple[str, str]] | None = None) -> None:
        """Profiles joins in one job: the given ones, or all on the way from the target that have no profile yet."""
        if pairs is None:
            pairs = [(a, b) for a, b in self.outward(self.target_relation or next(iter(self.features))) if self.edges[b][a].multiplicity is None]
        jobs = []
        for k, (left, right) in enumerate(pairs):
            edge = self.edges[left][right]
            jobs.append(edge_profile(self.table(left), self.table(right), edge.left_keys, edge.right_keys).withColumn("edge", F.lit(k)))
        for row in reduce(DataFrame.unionByName, jobs).collect() if jobs else ():
            left, right = pairs[row["edge"]]
            there, back = self.edges[left][right], self.edges[right][left]
            there.multiplicity, there.missing = row["left_multiplicity"], row["left_missing"]
            back.multiplicity, back.missing = row["right_multiplicity"], row["right_missing"]

    # looking things up
    def table(self, name: str) -> DataFrame:
        return self.catalog.table(name)

    def has_relation(self, name: str) -> bool:
        return name in self.features

    def has_join(self, left: str, right: str) -> bool:
        return right in self.edges.get(left, {})

    def join_keys(self, left: str, right: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        edge = self.edges[left][right]
        return edge.left_keys, edge.right_keys

    def keys_of(self, name: str) -> list[str]:
        return list(dict.fromkeys(k for e in self.edges[name].values() for k in e.left_keys))

    def useful_columns(self, name: str) -> list[str]:
        target = [self.target] if name == self.target_relation and self.target else []
        return list(dict.fromkeys([*self.features[name], *target, *self.keys_of(name)]))

    def feature_kind(self, relation: str, feature: str) -> str:
        return self.features[relation][feature]

    def multiplicity(self, left: str, right: str, simple: bool = False) -> int | str | None:
        found = self.edges[left][right].multiplicity
        return ("M" if found > 1 else "1") if simple and found is not None else found

    def missing_keys(self, left: str, right: str) -> int | None:
        return self.edges[left][right].missing

    def base_relations(self) -> list[str]:
        return [r for r in self.features if r != self.target_relation]

    def all_features(self) -> list[tuple[str, str, str]]:
        return [(r, f, kind) for r, found in self.features.items() for f, kind in found.items()]

    # checks
    def check(self, strict: bool = True) -> None:
        """strict: the target must be in a fact table: all joins away from it, at any distance, are N:1 and complete;
        without it, only its direct neighbours are looked at."""
        self.check_endpoints()
        for name, found in self.features.items():
            self._check_columns(name, list(found))
        self.check_acyclic()
        self.check_target()
        self.check_fact(strict)

    def check_endpoints(self) -> None:
        for left, found in self.edges.items():
            for right in found:
                if left not in self.features or right not in self.features:
                    raise GraphError(f"the join of {left} and {right} misses a relation")

    def check_acyclic(self) -> None:
        if not self.features:
            raise GraphError("the graph is empty")
        seen: set[str] = set()

        def walk(at: str, before: str | None) -> None:
            if at in seen:
                raise GraphError("the joins form a cycle")
            seen.add(at)
            for other in self.edges[at]:
                if other != before:
                    walk(other, at)

        walk(next(iter(self.features)), None)
        if seen != set(self.features):
            raise GraphError(f"{', '.join(sorted(set(self.features) - seen))}: not joined with the rest")

    def check_target(self) -> None:
        if self.target is None:
            raise GraphError("there is no target")
        self._check_columns(self.target_relation, [self.target])

    def check_fact(self, strict: bool = True) -> None:
        target = self.target_relation
        ways = self.outward(target) if strict else [(target, other) for other in self.edges[target]]
        self.profile_all([(a, b) for a, b in ways if self.edges[b][a].multiplicity is None])

        def walk(at: str, before: str | None) -> None:
            for other in self.edges[at]:
                if other == before:
                    continue
                back = self.edges[other][at]
                if back.multiplicity > 1:
                    raise GraphError(f"{other} has up to {back.multiplicity} rows for a key of {at}")
                if back.missing:
                    raise GraphError(f"{other} lacks {back.missing} keys of {at}")
                if strict:
                    walk(other, at)

        walk(self.target_relation, None)

    def not_functional(self) -> list[tuple[str, str]]:
        """Edges away from the target along which a row may meet several; edges without a profile get one."""
        found = []
        self.profile_all()
        for a, b in self.outward():
            if self.edges[b][a].multiplicity > 1:
                found.append((a, b))
        return found

    # changes
    def replace(self, old: str, new: str) -> None:
        """Renames a relation everywhere; it comes last from then on."""
        self.features[new] = self.features.pop(old)
        self.edges[new] = self.edges.pop(old)
        for other, edge in self.edges[new].items():
            edge.left = new
            back = self.edges[other].pop(old)
            back.right = new
            self.edges[other][new] = back
        if self.target_relation == old:
            self.target_relation = new

    def replace_attribute(self, relation: str, old: str, new: str) -> None:
        found = self.features[relation]
        self.features[relation] = {new if f == old else f: kind for f, kind in found.items()}
        if relation == self.target_relation and self.target == old:
            self.target = new
        swap = lambda keys: tuple(new if k == old else k for k in keys)
        for other, edge in self.edges[relation].items():
            edge.left_keys = swap(edge.left_keys)
            back = self.edges[other][relation]
            back.right_keys = swap(back.right_keys)

    # walks
    def outward(self, root: str | None = None) -> Iterator[tuple[str, str]]:
        """Edges away from root (the target's relation), parents first."""
        root = root or self.target_relation
        todo, seen = [root], {root}
        while todo:
            at = todo.pop(0)
            for other in self.edges[at]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
                    yield at, other

    def path(self, a: str, b: str) -> list[str]:
        before: dict[str, str] = {child: parent for parent, child in self.outward(a)}
        out = [b]
        while out[-1] != a:
            out.append(before[out[-1]])
        return out[::-1]

    def full_join(self, qualified: bool = False, root: str | None = None, how: str = "inner") -> DataFrame:
        """All relations joined; useful columns only, named relation.column if qualified. Keys are compared null-safe, as in training.

        Rows of root whose keys have no match go (inner) or have nulls in the other relations' columns (left)."""
        root = root or self.target_relation or next(iter(self.features))

        def columns(name: str) -> DataFrame:
            return self.table(name).select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in self.useful_columns(name)])

        rows = columns(root)
        for a, b in self.outward(root):
            edge = self.edges[a][b]
            on = [F.col(f"`{a}.{x}`").eqNullSafe(F.col(f"`{b}.{y}`")) for x, y in zip(edge.left_keys, edge.right_keys, strict=True)]
            rows = rows.join(columns(b), all_of(on), how)
        if qualified:
            return rows
        shown: dict[str, str] = {}
        for name in rows.columns:
            shown.setdefault(name.partition(".")[2], name)
        return rows.select(*[F.col(f"`{full}`").alias(short) for short, full in shown.items()])

    # for notebooks
    def as_dict(self) -> dict:
        nodes = [{"id": r, "name": r, "measurements": [], "attributes": list(f), "join_keys": self.keys_of(r)} for r, f in self.features.items()]
        links = []
        for left, found in self.edges.items():
            for right, edge in found.items():
                if left < right:
                    back = self.edges[right][left]
                    links.append(
                        {
                            "source": left, "target": right, "left_keys": list(edge.left_keys), "right_keys": list(edge.right_keys),
                            "multiplicity": [edge.multiplicity, back.multiplicity], "missing": [edge.missing, back.missing],
                        }
                    )
        return {"nodes": nodes, "links": links}

    def _repr_html_(self) -> str:
        """A drawing that needs nothing from outside: relations on a line by distance from the target, joins as labels."""
        found = self.as_dict()
        root = self.target_relation or next(iter(self.features), None)
        depth = {root: 0}
        for a, b in self.outward(root) if root else ():
            depth[b] = depth[a] + 1
        at, lines = {}, []
        for k, node in enumerate(sorted(found["nodes"], key=lambda n: (depth.get(n["id"], 0), n["id"]))):
            at[node["id"]] = (20 + 190 * depth.get(node["id"], 0), 30 + 60 * k)
        for link in found["links"]:
            (x1, y1), (x2, y2) = at[link["source"]], at[link["target"]]
            keys = ", ".join(f"{a}={b}" for a, b in zip(link["left_keys"], link["right_keys"], strict=True))
            lines.append(f'<line x1="{x1 + 60}" y1="{y1}" x2="{x2 + 60}" y2="{y2}" stroke="#999"><title>{html.escape(keys)}</title></line>')
        for node in found["nodes"]:
            x, y = at[node["id"]]
            tip = html.escape(", ".join(node["attributes"]) or "no features")
            lines.append(f'<g><title>{tip}</title><rect x="{x}" y="{y - 15}" width="130" height="30" rx="6" fill="#eef" stroke="#557"/><text x="{x + 8}" y="{y + 5}" font-size="12">{html.escape(node["name"])}</text></g>')
        tall, wide = 60 + 60 * len(at), 180 + 190 * max(depth.values(), default=0)
        data = json.dumps(found).replace("</", "<\\/")
        return f'<div id="graph-{uuid.uuid4().hex}"><svg width="{wide}" height="{tall}">{"".join(lines)}</svg><script type="application/json">{data}</script></div>'


def edge_profile(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """left_multiplicity, right_multiplicity, left_missing (keys of right that left lacks), right_missing; one row."""
    counted = []
    for frame, keys, n in ((left, left_keys, "l"), (right, right_keys, "r")):
        counted.append(frame.groupBy(*[F.col(f"`{k}`").alias(f"{n}_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(f"{n}_rows")))
    on = all_of([F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}")) for i in range(len(left_keys))])
    both = counted[0].join(counted[1], on, "full_outer")
    return both.agg(
        F.coalesce(F.max("l_rows"), F.lit(0)).alias("left_multiplicity"), F.coalesce(F.max("r_rows"), F.lit(0)).alias("right_multiplicity"),
        F.count_if(F.col("l_rows").isNull()).alias("left_missing"), F.count_if(F.col("r_rows").isNull()).alias("right_missing"),
    )


def walk_order(joins: dict[str, dict]) -> tuple[list[str], list[tuple[str, str]]]:
    """Relations and edges in depth-first order from the first relation that has one join (joins: relation -> its neighbours)."""
    start = next((r for r, found in joins.items() if len(found) <= 1), next(iter(joins)))
    nodes, edges = [], []

    def walk(at: str) -> None:
        nodes.append(at)
        for other in joins[at]:
            if other not in nodes:
                edges.append((at, other))
                walk(other)

    walk(start)
    return nodes, edges
