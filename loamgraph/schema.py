"""The property graph: kinds, edge types, table schemas and the frame that holds a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of nodes.
NODE_KINDS = (
    "repository", "package", "directory", "file", "module", "namespace", "class", "interface", "type", "enum",
    "function", "method", "constructor", "property", "variable", "constant", "route", "controller", "service",
    "repository_class", "database_model", "database_table", "test", "event", "event_handler", "queue",
    "queue_handler", "configuration", "feature", "concept",
)

# Types of edges.
EDGE_TYPES = (
    "CONTAINS", "IMPORTS", "EXPORTS", "REFERENCES", "CALLS", "CALLED_BY", "IMPLEMENTS", "EXTENDS", "RETURNS",
    "ACCEPTS", "READS", "WRITES", "TESTED_BY", "ROUTED_FROM", "DEPENDS_ON", "CONFIGURED_BY", "EMITS", "CONSUMES",
    "HANDLES", "CREATES", "UPDATES", "DELETES", "BELONGS_TO_FEATURE", "BELONGS_TO_CONCEPT",
)

# Edge types that make one node depend on another.
DEPENDENCY_TYPES = (
    "CALLS", "REFERENCES", "IMPORTS", "EXTENDS", "IMPLEMENTS", "DEPENDS_ON", "ACCEPTS", "RETURNS", "CONFIGURED_BY",
    "READS", "WRITES", "CREATES", "UPDATES", "DELETES", "EMITS", "CONSUMES",
)

FILES = "path string, hash string, language string, bytes bigint, lines int, indexed_at timestamp"
NODES = (
    "id string, kind string, name string, qualified_name string, language string, file string, start_line int, "
    "end_line int, start_offset int, end_offset int, signature string, visibility string, exported boolean, "
    "entry_point boolean, documentation string, framework string, route string, exceptions array<string>, "
    "search_terms array<string>, source_hash string"
)
EDGES = "source string, target string, type string, owner string, confidence double, evidence string, line int"


@dataclass(frozen=True)
class Graph:
    """``nodes`` (id, kind, name, qualified_name, file, exported, entry_point, ...) and ``edges`` (source, target,
    type, owner, ...)."""

    nodes: DataFrame
    edges: DataFrame

    def edges_of(self, types: tuple[str, ...] | list[str] | None) -> DataFrame:
        return self.edges if types is None else self.edges.where(F.col("type").isin(list(types)))
