"""A select-project-join-aggregate query as data, compiled to a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Attribute, Expression, Op, Predicate, Test, Value, all_of, column, predicate_column
from ..operators.running import running
from ..sources.catalog import Catalog


class QueryError(Exception):
    pass


@dataclass
class Query:
    """columns: output name -> Expression, column or SQL text; all columns if there are none.

    tables are names of the catalog or DataFrames by alias; joins are pairs of attributes that must not differ
    (null equals null); where is a list of predicates, semi joins among them. window_by orders running aggregates
    (range frame: ties share a value; sums by place are written to the shared folder). sample_rate keeps each row of the result with that chance."""

    columns: Mapping[str, Expression | Value] = field(default_factory=dict)
    tables: Sequence[str] | Mapping[str, DataFrame] = ()
    joins: Sequence[tuple[Attribute, Attribute]] = ()
    where: Sequence[Predicate | Column | str] = ()
    group_by: Sequence[Value] = ()
    window_by: Sequence[str] = ()
    order_by: Sequence[tuple[str, str]] = ()
    limit: int | None = None
    sample_rate: float | None = None
    seed: int = 0

    def compile(self, catalog: Catalog) -> DataFrame:
        rows = self._joined(catalog)
        plain = [predicate_column(p) for p in self.where if not (isinstance(p, Predicate) and p.test is Test.SEMI_JOIN)]
        if plain:
            rows = rows.filter(all_of(plain))
        for p in self.where:
            if isinstance(p, Predicate) and p.test is Test.SEMI_JOIN:
                rows = self._semi(rows, p, catalog)
        rows = self._projected(rows)
        if self.sample_rate is not None:
            rows = rows.sample(withReplacement=False, fraction=self.sample_rate, seed=self.seed)
        if self.order_by:
            order = {"asc": lambda c: F.col(c).asc_nulls_last(), "desc": lambda c: F.col(c).desc_nulls_last()}
            rows = rows.orderBy(*[order[d.lower()](c) for c, d in self.order_by])
        return rows if self.limit is None else rows.limit(self.limit)

    def _joined(self, catalog: Catalog) -> DataFrame:
        """Tables in the order of a walk over the joins, each joined on all keys that it shares with those before."""
        frames = dict(self.tables) if isinstance(self.tables, Mapping) else {t: catalog.table(t) for t in self.tables}
        if not frames:
            raise QueryError("a query needs a table")
        names = list(frames)
        done, rows = {names[0]}, frames[names[0]].alias(names[0])
        left = names[1:]
        while left:
            for name in left:
                on = [a.column.eqNullSafe(b.column) for a, b in self.joins if {a.table, b.table} <= done | {name} and name in (a.table, b.table)]
                if on:
                    rows = rows.join(frames[name].alias(name), all_of(on), "inner")
                    done.add(name)
                    left.remove(name)
                    break
            else:
                raise QueryError(f"{', '.join(left)}: not joined with {', '.join(sorted(done))}")
        return rows

    @staticmethod
    def _semi(rows: DataFrame, p: Predicate, catalog: Catalog) -> DataFrame:
        table, there = p.right
        frame = table if isinstance(table, DataFrame) else catalog.table(table)
        keys = frame.select(*[F.col(c).alias(f"__semi_{k}") for k, c in enumerate(there)])
        return rows.join(keys, all_of([column(c).eqNullSafe(F.col(f"__semi_{k}")) for k, c in enumerate(p.left)]), "left_semi")

    def _projected(self, rows: DataFrame) -> DataFrame:
        out = {n: e if isinstance(e, Expression) else Expression(Op.IDENTITY, e) for n, e in self.columns.items()}
        if self.window_by:
            return running(rows, out, self.window_by)
        if self.group_by:
            keys = [column(g) for g in self.group_by]
            plain = [e.column.alias(n) for n, e in out.items() if not e.is_aggregate]
            totals = [e.column.alias(n) for n, e in out.items() if e.is_aggregate]
            if not totals:
                return rows.select(*(plain or keys)).distinct()
            names = [f"__key_{k}" for k in range(len(keys))]
            grouped = rows.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(*totals)
            by_text = {str(k): n for k, n in zip(keys, names, strict=True)}
            shown = []
            for n, e in out.items():
                key = by_text.get(str(e.column))
                if not e.is_aggregate and key is None:
                    raise QueryError(f"{n} is neither grouped nor aggregated")
                shown.append(F.col(n if e.is_aggregate else key).alias(n))
            return grouped.select(*shown)
        if not out:
            return rows
        if any(e.op is Op.DISTINCT_IDENTITY for e in out.values()):
            return rows.select(*[e.column.alias(n) for n, e in out.items()]).distinct()
        if all(e.is_aggregate for e in out.values()):
            return rows.agg(*[e.column.alias(n) for n, e in out.items()])
        return rows.select(*[e.column.alias(n) for n, e in out.items()])


def run(query: Query, catalog: Catalog, mode: str = "execute") -> list[tuple] | str | DataFrame:
    """mode: execute (rows), write (name of a written table), view (name of a lazy one) or nested (a DataFrame to build on)."""
    df = query.compile(catalog)
    modes = {"execute": catalog.fetch, "write": catalog.write, "view": catalog.view, "nested": lambda x: x}
    if mode not in modes:
        raise QueryError(f"no mode {mode}")
    return modes[mode](df)
