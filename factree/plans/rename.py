"""Columns that are called like the engine's own get other names while a model is trained."""

from __future__ import annotations

import json
from collections.abc import Iterable

from .graph import GraphError, JoinGraph

RESERVED = ("s", "c", "node", "rowid", "row_id")
PREFIX = "reserved_"


def free_name(name: str, taken: Iterable[str]) -> str:
    """name with as many prefixes as make it free."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = PREFIX + name
    return name


def without_reserved(graph: JoinGraph) -> tuple[JoinGraph, dict[tuple[str, str], str]]:
    """A copy of the graph over views with other names, and (relation, new name) -> old name."""
    graph, back = graph.copy(), {}
    tables = dict(graph.catalog.tables)
    catalog = type(graph.catalog)(graph.catalog.spark)
    catalog.tables = tables
    graph.catalog = catalog
    for relation in list(graph.features):
        frame = graph.table(relation)
        for old in frame.columns:
            if old.lower() in RESERVED:
                new = free_name(PREFIX + old, frame.columns)
                frame = frame.withColumnRenamed(old, new)
                graph.replace_attribute(relation, old, new)
                back[relation, new] = old
        tables[relation] = frame
    return graph, back


def replay(graph: JoinGraph, text: str) -> JoinGraph:
    """A copy of the graph over views with the renames that history() wrote, such as for tables that a model is to score later.

    Renames that are done already are skipped; those of relations or columns that the graph does not have are an error."""
    graph = graph.copy()
    catalog = type(graph.catalog)(graph.catalog.spark)
    catalog.tables = dict(graph.catalog.tables)
    graph.catalog = catalog
    for step in json.loads(text):
        relation, old, new = step["relation"], step["old"], step["new"]
        if not graph.has_relation(relation):
            raise GraphError(f"{relation} is not in the graph")
        frame = graph.table(relation)
        if new in frame.columns and old not in frame.columns:
            continue
        if old not in frame.columns or new in frame.columns:
            raise GraphError(f"{relation}: {old} can't become {new}")
        catalog.tables[relation] = frame.withColumnRenamed(old, new)
        graph.replace_attribute(relation, old, new)
    return graph


def history(back: dict[tuple[str, str], str]) -> str:
    return json.dumps([{"relation": r, "new": new, "old": old} for (r, new), old in back.items()])
