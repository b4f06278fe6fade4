"""Factorized aggregation: messages along the edges of a join graph instead of its join.

The target's table is lifted to (s, c) per row. A message along an edge carries what the receiver must know of
everything behind the sender: nothing (the sender filters nothing and has one row for each key), the keys that are
left, or (s, c) by key. Any aggregate of the full join by columns of one relation is that relation joined with its
incoming messages. Each message is a lazy DataFrame: partial sums below the joins, which Catalyst plans as usual.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Predicate, all_of, predicate_column
from ..plans.graph import JoinGraph
from ..sources.shared import release, scratch
from .semiring import Variance


class Kind(Enum):
    IDENTITY = "nothing"
    SELECTION = "keys"
    FULL = "sums by key"
    UNDECIDED = "keys or sums, by what the sender got"


@dataclass(frozen=True)
class Message:
    kind: Kind
    rows: DataFrame | None = None  # columns k0, k1, ... and, if full, s and c


@dataclass
class MessageTree:
    """A calibrated join graph. copy() shares messages, so a child of a tree node sends only what its own predicates change."""

    graph: JoinGraph
    frames: dict[str, DataFrame] = field(default_factory=dict)
    predicates: dict[str, list[Predicate | Column | str]] = field(default_factory=dict)
    messages: dict[tuple[str, str], Message] = field(default_factory=dict)
    total: Variance = field(default_factory=Variance)
    semi_join: bool = False  # reduce a sender by the keys that its receiver has

    def copy(self, total: Variance | None = None) -> MessageTree:
        kept = {r: list(p) for r, p in self.predicates.items()}
        return replace(self, frames=dict(self.frames), predicates=kept, messages=dict(self.messages), total=total or self.total)

    def frame(self, relation: str) -> DataFrame:
        return self.frames[relation] if relation in self.frames else self.graph.table(relation)

    def add_predicates(self, relation: str, predicates: Sequence[Predicate | Column | str]) -> None:
        self.predicates.setdefault(relation, []).extend(predicates)

    def filtered(self, relation: str) -> DataFrame:
        rows = self.frame(relation)
        found = self.predicates.get(relation)
        return rows.filter(all_of([predicate_column(p) for p in found])) if found else rows

    def lift(self, value: Column | None = None, persist: bool = False) -> DataFrame:
        """The target's table as s, c, its features and keys; s is the target less nothing unless value says else."""
        graph = self.graph
        columns = [c for c in graph.useful_columns(graph.target_relation) if c != graph.target or c in graph.keys_of(graph.target_relation)]
        value = F.col(f"`{graph.target}`") if value is None else value
        rows = self.frame(graph.target_relation).select(*Variance.lift(value), *[F.col(f"`{c}`") for c in columns])
        if persist:
            rows = scratch(graph.catalog.spark, rows, "lifted")
        self.frames[graph.target_relation] = rows
        return rows

    # sending
    def calibrate(self, root: str | None = None) -> None:
        """Leaves to root with identities, where edges allow them, then root to leaves."""
        root = root or self.graph.target_relation
        self.graph.profile_all()
        for parent, child in reversed(list(self.graph.outward(root))):
            self.send(child, parent, Kind.IDENTITY if self._is_identity(child, parent) else Kind.UNDECIDED)
        self.send_down(root)

    def send_down(self, root: str | None = None) -> None:
        """Messages away from root; the others stay as they are."""
        for parent, child in self.graph.outward(root or self.graph.target_relation):
            self.send(parent, child, Kind.UNDECIDED)

    def _is_identity(self, sender: str, receiver: str) -> bool:
        """The sender filters nothing, nor does anything behind it, and each key of the receiver has just one row there."""
        edge, back = self.graph.edges[sender][receiver], self.graph.edges[receiver][sender]
        behind = [m for o in self.graph.edges[sender] if o != receiver and (m := self.messages.get((o, sender)))]
        plain = not self.predicates.get(sender) and sender != self.graph.target_relation and all(m.kind is Kind.IDENTITY for m in behind)
        return plain and edge.multiplicity == 1 and edge.missing == 0 and back is not None

    def send(self, sender: str, receiver: str, kind: Kind) -> Message:
        if kind is Kind.IDENTITY:
            message = Message(kind)
        else:
            got = [m.kind for o in self.graph.edges[sender] if o != receiver and (m := self.messages.get((o, sender)))]
            if kind is Kind.UNDECIDED:
                kind = Kind.FULL if sender == self.graph.target_relation or Kind.FULL in got else Kind.SELECTION
            rows, s, c = self._joined(sender, but=receiver)
            edge = self.graph.edges[sender][receiver]
            keys = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(edge.left_keys)]
            if self.semi_join and (m := self.messages.get((receiver, sender))) and m.rows is not None:
                rows = self._join(rows, m, receiver, sender, "left_semi", "back")
            if kind is Kind.FULL:
                out = rows.select(*keys, s.alias("s"), c.alias("c")).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(*Variance.sums())
            else:
                out = rows.select(*keys).distinct()
            message = Message(kind, out)
        self.messages[sender, receiver] = message
        return message

    def _join(self, rows: DataFrame, message: Message, sender: str, receiver: str, how: str, name: str) -> DataFrame:
        keys = self.graph.edges[receiver][sender].left_keys
        sent = message.rows.select(*[F.col(c).alias(f"__{name}_{c}") for c in message.rows.columns])
        on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{name}_k{i}")) for i, k in enumerate(keys)]
        return rows.join(sent, all_of(on), how)

    def _joined(self, relation: str, but: str | None = None) -> tuple[DataFrame, Column, Column]:
        """The filtered relation with its messages, and its rows' s and c as products over them."""
        rows = self.filtered(relation)
        own = relation == self.graph.target_relation
        pair = (F.col("s"), F.col("c")) if own else (F.lit(0), F.lit(1).cast("long"))
        for n, other in enumerate(self.graph.edges[relation]):
            message = self.messages.get((other, relation))
            if other == but or message is None or message.kind is Kind.IDENTITY:
                continue
            if message.kind is Kind.SELECTION:
                rows = self._join(rows, message, other, relation, "left_semi", f"m{n}")
            else:
                rows = self._join(rows, message, other, relation, "inner", f"m{n}")
                pair = Variance.product(pair, (F.col(f"__m{n}_s"), F.col(f"__m{n}_c")))
        return rows, *pair

    # reading
    def absorb(self, relation: str, group_by: Sequence[str] = ()) -> DataFrame:
        """group_by, s and c of the full join, by columns of one relation."""
        rows, s, c = self._joined(relation)
        rows = rows.select(*[F.col(f"`{g}`") for g in group_by], s.alias("s"), c.alias("c"))
        return rows.groupBy(*[f"`{g}`" for g in group_by]).agg(*Variance.sums()) if group_by else rows.agg(*Variance.sums())

    def partition_target(self, relation: str) -> DataFrame | None:
        """The target's rows that the predicates on the way to relation leave; None if that is the target's relation."""
        target = self.graph.target_relation
        if relation == target:
            return None
        path = self.graph.path(target, relation)
        sent = self.copy()
        for a, b in zip(path[:0:-1], path[-2::-1], strict=True):
            sent.send(a, b, Kind.SELECTION)
        return sent._join(self.filtered(target), sent.messages[path[1], target], path[1], target, "left_semi", "part")

    def clean(self) -> None:
        """Forgets the messages, which are lazy, and deletes a lifted table that was written."""
        self.messages.clear()
        release(*self.frames.values())
        self.frames.clear()
