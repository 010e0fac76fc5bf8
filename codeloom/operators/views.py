"""Smaller reads over the graph that tools are made of."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators.search import bm25_nodes, fuse


def under(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes of one path or below it; ``src/a`` does not take in ``src/ab``."""
    p = prefix.rstrip("/")
    return nodes.where((F.col("file_path") == p) | F.col("file_path").startswith(p + "/"))


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``**`` any path, ``*`` and ``?`` within a segment."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def glob_files(g: PropertyGraph, pattern: str) -> DataFrame:
    return g.label("File").where(F.col("file_path").rlike(glob_regex(pattern)))


def find_names(nodes: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """The first symbols by name that a regular expression finds."""
    return nodes.where(F.col("name").rlike(pattern)).select("id", "label", "name", "file_path").orderBy("name", "id").limit(limit)


def insights(g: PropertyGraph, node_id: str, most: int = 10) -> DataFrame:
    """``direction, id, name``: up to ``most`` neighbours each way and the community."""
    def side(own: str, other: str, name: str, types: tuple[str, ...] = ()) -> DataFrame:
        e = g.out_edges(*types).where(F.col(own) == node_id).select(F.col(other).alias("id")).distinct()
        return e.join(g.nodes.select("id", "name"), "id").orderBy("id").limit(most).select(F.lit(name).alias("direction"), "id", "name")

    return side("source_id", "target_id", "out").unionByName(side("target_id", "source_id", "in")).unionByName(side("source_id", "target_id", "community", ("MEMBER_OF",)))


def features(g: PropertyGraph, limit: int = 50) -> DataFrame:
    """Communities with most members first; without any, the heuristic labels of nodes with their numbers."""
    m = g.out_edges("MEMBER_OF").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_members"))
    known = g.label("Community").select("id", "name")
    if not known.take(1) and "heuristic_label" in g.nodes.columns:
        by_label = g.nodes.where("heuristic_label is not null").groupBy(F.col("heuristic_label").alias("name")).agg(F.count(F.lit(1)).alias("n_members"))
        return by_label.select(F.col("name").alias("id"), "name", "n_members").orderBy(F.desc("n_members"), "id").limit(limit)
    return known.join(m, "id", "left").select("id", "name", F.coalesce("n_members", F.lit(0)).alias("n_members")).orderBy(F.desc("n_members"), "id").limit(limit)


def file_symbols(g: PropertyGraph, path: str) -> DataFrame:
    """``id, label, name, start_line, end_line, description`` of what a file holds, in order; goes with a slice of it."""
    cols = [c if c in g.nodes.columns else F.lit(None).cast("string").alias(c) for c in ("id", "label", "name", "start_line", "end_line", "description")]
    return g.file(path).where("label <> 'File'").select(*cols).orderBy(F.asc_nulls_last("start_line"), "id")


def process_entities(g: PropertyGraph) -> DataFrame:
    """``process_id, entity_id, name, mode``: entities that the steps of a process reach, with the kind of access."""
    s = g.out_edges("STEP_IN_PROCESS").select(F.col("source_id").alias("step_id"), F.col("target_id").alias("process_id"))
    e = g.out_edges("MAPS_TO_ENTITY", "ACCESSES").select(F.col("source_id").alias("step_id"), F.col("target_id").alias("entity_id"), F.lower(F.coalesce("reason", F.lit(""))).alias("reason"))
    n = g.nodes.where(F.col("label").isin("DbEntity", "DbContext")).select(F.col("id").alias("entity_id"), "name")
    reads, writes = F.bool_or(F.col("reason").contains("read")), F.bool_or(F.col("reason").contains("write"))
    a = s.join(e, "step_id").join(n, "entity_id").groupBy("process_id", "entity_id", "name").agg(reads.alias("r"), writes.alias("w"))
    return a.select("process_id", "entity_id", "name", F.when(F.col("r") & F.col("w"), "read+write").when(F.col("w"), "write").otherwise("read").alias("mode"))


def evidence(g: PropertyGraph, symbols: DataFrame) -> DataFrame:
    """``chunk_id, symbol_id``: chunks that mention the symbols (``id``), the least symbol of each chunk."""
    m = g.out_edges("MENTIONS").join(symbols.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return m.groupBy(F.col("source_id").alias("chunk_id")).agg(F.min("target_id").alias("symbol_id"))


def marker_probes(nodes: DataFrame, markers: dict[str, str]) -> DataFrame:
    """One row: for each marker whether any name holds its text, in one pass."""
    return nodes.agg(*[F.coalesce(F.bool_or(F.lower("name").contains(text.lower())), F.lit(False)).alias(key) for key, text in markers.items()])


def retrieve(nodes: DataFrame, query: str, limit: int = 10, near: DataFrame | None = None) -> DataFrame:
    """``rank, id, score`` for a question: BM25 fused with a semantic list (``id, rank``), or filled up with names that
    hold the query."""
    hits = bm25_nodes(nodes, query, limit=max(2 * limit, 20)).select("id", "score", "rank")
    if near is not None:
        return fuse(("bm25", hits), ("semantic", near), key="id", limit=limit).select("rank", "id", "score")
    from codeloom.functions.kernels import path_weight

    names = nodes.where(F.lower("name").contains(query.lower())).select("id", path_weight(F.col("file_path")).alias("score")).join(hits.select("id"), "id", "left_anti")
    both = hits.select("id", "score").unionByName(names).orderBy(F.desc("score"), "id").limit(limit)
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("rank", "id", "score")


def doc_chunks(nodes: DataFrame, near: DataFrame, limit: int = 3, most: int = 600) -> DataFrame:
    """The best document chunks of a semantic list (``id, rank``), with an excerpt."""
    c = nodes.where(F.col("label") == "DocChunk").join(near, "id").orderBy("rank", "id").limit(limit)
    return c.select("id", "name", F.substring("content", 1, most).alias("excerpt"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``file, module, target``: files whose path without extension ends in the module, the shortest first.

    ``imports`` has ``file, module``, ``files`` has ``path``. Every path is indexed by its suffixes of up to six
    segments, so that the join is one equality.
    """
    p = files.select("path", F.split(F.regexp_replace("path", r"/(?:index\.[jt]sx?|__init__\.py|mod\.rs)$|\.[A-Za-z]+$", ""), "/").alias("s"))
    at = F.explode(F.sequence(F.greatest(F.size("s") - 5, F.lit(1)), F.size("s")))
    suffix = p.select("path", "s", at.alias("k")).select("path", F.array_join(F.slice("s", F.col("k"), F.size("s") - F.col("k") + 1), "/").alias("suffix"))
    m = imports.select("file", "module", F.regexp_replace(F.regexp_replace(F.regexp_replace("module", r"^(?:\.{1,2}/)+|^\.+", ""), r"\.(?:js|ts|jsx|tsx|py)$", ""), r"\.|::|\\", "/").alias("suffix")).distinct()
    j = m.join(suffix, "suffix").where("file <> path")
    return j.groupBy("file", "module").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("b")).select("file", "module", F.col("b.path").alias("target"))
