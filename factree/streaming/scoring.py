"""Scoring streams: a model is a column, so a stream of joined rows or of facts is scored without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import all_of
from ..plans.graph import JoinGraph
from ..plans.models import DummyModel


def score(rows: DataFrame, model: DummyModel, name: str = "prediction") -> DataFrame:
    """rows (batch or stream) with the model's features by name, and the prediction."""
    return rows.withColumn(name, model.column())


def score_facts(facts: DataFrame, graph: JoinGraph, model: DummyModel, name: str = "prediction") -> DataFrame:
    """facts: rows like the graph's target relation, from a stream; the other relations are joined as they are (stream-static joins).

    Every fact gets a score: where a key has no match, the features behind it are null, which goes right."""
    target = graph.target_relation
    rows = facts.select(*[F.col(f"`{c}`").alias(f"{target}.{c}") for c in facts.columns])
    for a, b in graph.outward():
        edge = graph.edges[a][b]
        there = graph.table(b).select(*[F.col(f"`{c}`").alias(f"{b}.{c}") for c in graph.useful_columns(b)])
        on = [F.col(f"`{a}.{x}`").eqNullSafe(F.col(f"`{b}.{y}`")) for x, y in zip(edge.left_keys, edge.right_keys, strict=True)]
        rows = rows.join(there, all_of(on), "left")
    own = [F.col(f"`{target}.{c}`").alias(c) for c in facts.columns]
    return rows.select(*own, model.column(qualified=True).alias(name))
