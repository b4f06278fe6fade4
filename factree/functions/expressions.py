"""Aggregates, scalar expressions and predicates, as Spark columns."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """A column of a table; equal to a plain name if the names are."""

    table: str
    name: str

    def __eq__(self, other: object) -> bool:
        if isinstance(other, str):
            return self.name == other
        return isinstance(other, Attribute) and (self.table, self.name) == (other.table, other.name)

    def __hash__(self) -> int:
        return hash(self.name)

    @property
    def column(self) -> Column:
        return F.col(f"`{self.table}`.`{self.name}`")


Value = Column | Attribute | str | int | float | bool


def column(value: Value) -> Column:
    """Text is SQL, an attribute its qualified column, other Python values are literals."""
    if isinstance(value, Column):
        return value
    if isinstance(value, Attribute):
        return value.column
    return F.expr(value) if isinstance(value, str) else F.lit(value)


def constant(value: object) -> Column:
    """Like column(), but text is a literal."""
    return F.lit(value) if isinstance(value, str) else column(value)


class Op(Enum):
    SUM = "sum"
    MAX = "max"
    MIN = "min"
    COUNT = "count"
    DISTINCT_COUNT = "distinct count"
    AVG = "avg"
    SUM_PROD = "sum of products"
    DISTRIBUTED_SUM_PROD = "sum of sums of products"
    PROD = "product"
    ADD = "add"
    SUB = "subtract"
    DIV = "divide"
    IDENTITY = "identity"
    IDENTITY_LAMBDA = "SQL text"
    DISTINCT_IDENTITY = "distinct values"
    SQRT = "square root"
    POW = "power"
    CAST = "cast"
    CASE = "case"


AGGREGATES = {Op.SUM, Op.MAX, Op.MIN, Op.COUNT, Op.DISTINCT_COUNT, Op.AVG, Op.SUM_PROD, Op.DISTRIBUTED_SUM_PROD}

def product(factors: Sequence[Value]) -> Column:
    return reduce(operator.mul, map(column, factors))


def _factors(factors: Mapping[str, str] | Sequence[Value]) -> Column:
    """A mapping gives a column for each table."""
    if isinstance(factors, Mapping):
        factors = [Attribute(t, c) for t, c in factors.items()]
    return product(factors)


def case(branches: Sequence[tuple[Value, Sequence[Column]]]) -> Column:
    """The double of the first branch whose predicates all hold, 0 if none does."""
    out: Column | None = None
    for value, predicates in branches:
        holds = all_of([predicate_column(p) for p in predicates])
        value = column(value).cast("double")
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return F.lit(0.0) if out is None else out.otherwise(F.lit(0.0))


_RULES = {
    Op.SUM: lambda x: F.sum(column(x)),
    Op.MAX: lambda x: F.max(column(x)),
    Op.MIN: lambda x: F.min(column(x)),
    Op.COUNT: lambda x: F.count("*") if x == "*" else F.count(column(x)) if not isinstance(x, (list, tuple)) else F.count_if(all_of([column(c).isNotNull() for c in x])),
    Op.DISTINCT_COUNT: lambda x: F.count_distinct(*map(column, x if isinstance(x, (list, tuple)) else [x])),
    Op.AVG: lambda x: F.avg(column(x)),
    Op.SUM_PROD: lambda xs: F.sum(_factors(xs)),
    Op.DISTRIBUTED_SUM_PROD: lambda terms: F.sum(reduce(operator.add, map(product, terms))),
    Op.PROD: lambda xs: product([column(x).cast("double") for x in xs]),
    Op.ADD: lambda xs: reduce(operator.add, map(column, xs)),
    Op.SUB: lambda xs: column(xs[0]) - column(xs[1]),
    Op.DIV: lambda xs: F.try_divide(column(xs[0]).cast("double"), column(xs[1]).cast("double")),
    Op.IDENTITY: column,
    Op.IDENTITY_LAMBDA: column,
    Op.DISTINCT_IDENTITY: column,
    Op.SQRT: lambda x: F.sqrt(column(x)),
    Op.POW: lambda xs: F.pow(column(xs[0]), column(xs[1])),
    Op.CAST: lambda xs: column(xs[0]).cast(xs[1]),
    Op.CASE: case,
}


@dataclass(frozen=True)
class Expression:
    op: Op
    of: object

    @property
    def is_aggregate(self) -> bool:
        return self.op in AGGREGATES

    @property
    def column(self) -> Column:
        if self.op not in _RULES:
            raise ValueError(f"unknown operation {self.op}")
        return _RULES[self.op](self.of)

    @property
    def taken_of(self) -> Column:
        """The value of a row that an aggregate is taken of; a count is taken of ones."""
        if self.op is Op.COUNT:
            wanted = [] if self.of == "*" else self.of if isinstance(self.of, (list, tuple)) else [self.of]
            one = F.lit(1).cast("long")
            return F.when(all_of([column(c).isNotNull() for c in wanted]), one) if wanted else one
        if self.op is Op.SUM_PROD:
            return _factors(self.of)
        if self.op is Op.DISTRIBUTED_SUM_PROD:
            return reduce(operator.add, map(product, self.of))
        return column(self.of)


class Test(Enum):
    __test__ = False  # not a test class

    NULL = "is null"
    NOT_NULL = "is not null"
    NOT_GREATER = "<="
    LESSER = "<"
    GREATER = ">"
    DISTINCT = "is distinct from"
    NOT_DISTINCT = "is not distinct from"
    IN = "in"
    NOT_IN = "not in"
    EQUAL = "="
    NOT_EQUAL = "!="
    SEMI_JOIN = "semi join"


def _listed(value: Value, members: Sequence[object]) -> Column:
    """Membership that knows null: null is a member if the list has it."""
    known = [m for m in members if m is not None]
    found = F.coalesce(column(value).isin(known), F.lit(False)) if known else F.lit(False)
    return found | column(value).isNull() if len(known) < len(members) else found


_TESTS = {
    Test.NULL: lambda a, _: column(a).isNull(),
    Test.NOT_NULL: lambda a, _: column(a).isNotNull(),
    Test.NOT_GREATER: lambda a, b: column(a) <= constant(b),
    Test.LESSER: lambda a, b: column(a) < constant(b),
    Test.GREATER: lambda a, b: column(a) > constant(b),
    Test.DISTINCT: lambda a, b: ~column(a).eqNullSafe(constant(b)),
    Test.NOT_DISTINCT: lambda a, b: column(a).eqNullSafe(constant(b)),
    Test.IN: _listed,
    Test.NOT_IN: lambda a, b: ~_listed(a, b),
    Test.EQUAL: lambda a, b: column(a) == constant(b),
    Test.NOT_EQUAL: lambda a, b: column(a) != constant(b),
}


@dataclass(frozen=True)
class Predicate:
    """left and right by kind; for SEMI_JOIN, left are attributes and right is (table, attributes there)."""

    test: Test
    left: object
    right: object = None

    @property
    def column(self) -> Column:
        if self.test is Test.SEMI_JOIN:
            raise ValueError("a semi join is a join, not a column")
        return _TESTS[self.test](self.left, self.right)


def predicate_column(p: Predicate | Column | str) -> Column:
    return p.column if isinstance(p, Predicate) else column(p)


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(operator.and_, predicates, F.lit(True)) if predicates else F.lit(True)
