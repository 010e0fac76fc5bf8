"""Procedures behind CALL; a registry that callers may extend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.lang.syntax import QueryError
from codeloom.operators.search import bm25_nodes

PROCEDURES: dict[str, Callable[[PropertyGraph, str, list], DataFrame]] = {}


def procedure(name: str):
    def register(f):
        PROCEDURES[name.upper()] = f
        return f

    return register


@procedure("QUERY_FTS_INDEX")
def query_fts_index(graph: PropertyGraph, dialect: str, args: list) -> DataFrame:
    """cql: names that hold the text; cypher: the 100 best by BM25, of the label in ``fts_<Label>``."""
    if len(args) < 2 or not isinstance(args[1], str):
        raise QueryError("QUERY_FTS_INDEX needs a table and a text")
    if dialect == "cql":
        return graph.nodes.where(F.lower("name").contains(args[1].lower())).select("id", "name", "label", "file_path")
    label = str(args[0])[4:] if str(args[0]).lower().startswith("fts_") else None
    return bm25_nodes(graph.nodes, args[1], labels=[label] if label else None, limit=100)
