"""Traversals: breadth-first loops that keep the frontier small and the edges where they are."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.kernels import risk
from codeloom.graph import PropertyGraph
from codeloom.session import is_empty
from codeloom.session import settle as materialize

#: Edges along which a change has effects; edges that the wider search leaves out.
CAUSAL = ("CALLS", "CALLS_ACTION", "CALLS_SERVICE", "IMPORTS", "USES", "DEPENDS_ON", "INHERITS", "IMPLEMENTS", "EXTENDS", "OVERRIDES", "RENDERS_VIEW", "HANDLES_ROUTE", "FETCHES", "MAPS_TO_ENTITY")
NOT_CAUSAL = ("CONTAINS", "STEP_IN_PROCESS", "DEFINES", "MEMBER_OF", "BELONGS_TO_AREA")


def steps(edges: DataFrame, direction: str, types: tuple[str, ...] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (a, b) moves: out along the edges, in against them, both."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    e = e.where(~F.col("type").isin(*without)) if without else e
    out = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))
    return {"out": out, "in": back, "both": out.unionAll(back)}[direction].distinct()


def bfs(seeds: DataFrame, moves: DataFrame, depth: int | None) -> DataFrame:
    """``seed, id, depth``: least depth of every node reached from each seed (``seed, id``), seeds at 0."""
    moves, k = materialize(moves), 0
    seen, n = materialize(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0))), 0
    while depth is None or k < depth:
        new = seen.where(F.col("depth") == k).join(moves, F.col("id") == F.col("a")).select("seed", F.col("b").alias("id"), F.lit(k + 1).alias("depth"))
        # one table of what was reached, written anew each round: the least depth of a pair stays
        seen = materialize(seen.unionByName(new).groupBy("seed", "id").agg(F.min("depth").alias("depth")))
        k, n, was = k + 1, seen.count(), n
        if n == was:
            break
    return seen


def seeds_of(g: PropertyGraph, what: str) -> DataFrame:
    """Nodes with this id or, whatever the case, this name, as one seed."""
    return g.nodes.where((F.col("id") == what) | (F.lower("name") == what.lower())).select(F.lit(what).alias("seed"), "id")


def impact(g: PropertyGraph, what: str, direction: str = "upstream", depth: int = 5, wide: bool = False) -> DataFrame:
    """``id, label, name, file_path, depth`` of what a change of ``what`` touches.

    wide: start also from members and sibling classes, and follow all edges but NOT_CAUSAL ones.
    """
    s = seeds_of(g, what)
    if wide and is_empty(s):  # names that hold the text, classes and controllers before others
        rank = F.when(F.col("label").isin("Controller", "Class", "Service"), 0).when(F.col("label").isin("Method", "Function"), 1).otherwise(2)
        s = g.nodes.where(F.lower("name").contains(what.lower())).orderBy(rank, "id").limit(1).select(F.lit(what).alias("seed"), "id")
    if wide:
        mine = s.join(g.nodes.select("id", "label", "name"), "id").where("label = 'Controller'").select("seed", "name")
        s = s.unionByName(mine.join(g.label("Class").select("name", "id"), "name").select("seed", "id"))
        members = g.out_edges("HAS_METHOD", "HAS_PROPERTY", "HAS_ACTION").select("source_id", F.col("target_id").alias("m_id"))
        s = s.unionByName(s.join(members, F.col("id") == F.col("source_id")).select("seed", F.col("m_id").alias("id")))
    moves = steps(g.edges, "in" if direction == "upstream" else "out", None if wide else CAUSAL, NOT_CAUSAL if wide else ())
    hit = bfs(s, moves, max(1, min(depth, 10))).where("depth > 0")
    out = hit.join(g.nodes.select("id", "label", "name", "file_path"), "id").select("id", "label", "name", "file_path", "depth")
    return out.where("label <> 'Community' and file_path not like '%/obj/%'") if wide else out


def impact_paths(g: PropertyGraph, node_id: str, direction: str = "upstream", depth: int = 5) -> DataFrame:
    """``id, label, name, file_path, depth, path``: what a change of one node touches, with the least shortest path to it.

    The greatest depth is the maximum of ``depth``, the affected files are the distinct ``file_path``; the edges among
    the nodes come from :func:`induced`.
    """
    moves = materialize(steps(g.edges, "in" if direction == "upstream" else "out", CAUSAL))
    seen, n = materialize(g.node(node_id).select("id", F.lit(0).alias("depth"), F.array("id").alias("path"))), 0
    for k in range(max(1, min(depth, 10))):
        new = seen.where(F.col("depth") == k).join(moves, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.lit(k + 1).alias("depth"), F.concat("path", F.array("b")).alias("path"))
        best = seen.unionByName(new).groupBy("id").agg(F.min(F.struct("depth", "path")).alias("r"))
        seen = materialize(best.select("id", "r.depth", "r.path"))
        n, was = seen.count(), n
        if n == was:
            break
    return seen.where("depth > 0").join(g.nodes.select("id", "label", "name", "file_path"), "id").select("id", "label", "name", "file_path", "depth", "path")


def induced(g: PropertyGraph, ids: DataFrame) -> DataFrame:
    """Edges both ends of which are in ``ids`` (column ``id``)."""
    i = ids.select("id").distinct()
    return g.edges.join(i.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(i.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(g.edges.columns)


def process_flow(g: PropertyGraph, most: int = 20) -> DataFrame:
    """``process_id, k, id, depth``: from the first step of every process along its calls, the first ``most`` symbols."""
    first = g.out_edges("STEP_IN_PROCESS").groupBy("target_id").agg(F.min(F.struct(F.coalesce("step", F.lit(1 << 30)).alias("step"), "source_id")).alias("f"))
    seeds = first.select(F.col("target_id").alias("seed"), F.col("f.source_id").alias("id"))
    hit = bfs(seeds, steps(g.edges, "out", ("CALLS", "CALLS_ACTION")), most)
    k = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "id"))
    return hit.withColumn("k", k).where(F.col("k") <= most).select(F.col("seed").alias("process_id"), "k", "id", "depth")


def shortest_path(g: PropertyGraph, start: str, goal: str, types: tuple[str, ...] | None = None, directed: bool = True, depth: int | None = 10) -> DataFrame:
    """``depth, path``: the least shortest path between two ids, or no row. A node reaches itself at depth 0."""
    moves = materialize(steps(g.edges, "out" if directed else "both", types))
    seen = front = materialize(g.node(start).select("id", F.array("id").alias("path")))
    k = 0
    while (depth is None or k < min(depth, 50)) and is_empty(front.where(F.col("id") == goal)) and not is_empty(front):
        k += 1
        new = front.join(moves, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = materialize(new.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(front)
    return front.where(F.col("id") == goal).select((F.size("path") - 1).alias("depth"), "path")


def subgraph(g: PropertyGraph, start: str, depth: int = 2, cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes around ``start`` (``id, depth``) in order of depth and id up to the cap, and the edges between them."""
    n = bfs(g.node(start).select("id", F.col("id").alias("seed")), steps(g.edges, "both"), min(depth, 5)).join(g.nodes.select("id"), "id", "left_semi")
    n = materialize(n.orderBy("depth", "id").limit(cap).select("id", "depth"))
    ids = F.broadcast(n.select("id"))  # at most cap rows
    e = g.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return n, e.select(g.edges.columns)


def neighbours(g: PropertyGraph, what: str, depth: int = 2) -> DataFrame:
    return bfs(seeds_of(g, what), steps(g.edges, "both"), min(depth, 5)).where("depth > 0").join(g.nodes.select("id", "label", "name"), "id").select("id", "label", "name", "depth")


def trace_files(g: PropertyGraph, what: str, depth: int = 3) -> DataFrame:
    """``file_path, n_symbols, depth``: files reached from a symbol and its members, which start at depth 1."""
    start = materialize(seeds_of(g, what))
    members = g.out_edges("HAS_METHOD", "HAS_PROPERTY").select("source_id", F.col("target_id").alias("m_id"))
    moves = steps(g.edges, "out", None, ("HAS_METHOD", "HAS_PROPERTY"))
    own = bfs(start, moves, depth)
    of_members = bfs(start.join(members, F.col("id") == F.col("source_id")).select("seed", F.col("m_id").alias("id")), moves, depth - 1).withColumn("depth", F.col("depth") + 1)
    both = own.unionByName(of_members).groupBy("id").agg(F.min("depth").alias("depth"))
    return both.join(g.nodes.select("id", "file_path"), "id").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("depth").alias("depth"))


def coverage_flow(g: PropertyGraph, cls: str, depth: int = 3) -> DataFrame:
    """``id, name, depth, is_traced`` of the methods of a class and what they call."""
    m = g.nodes.where((F.col("name") == cls) & F.col("label").isin("Class", "Controller", "Struct")).select(F.col("id").alias("c_id")).join(g.out_edges("HAS_METHOD"), F.col("c_id") == F.col("source_id")).select(F.lit(cls).alias("seed"), F.col("target_id").alias("id"))
    hit = bfs(m, steps(g.edges, "out", ("CALLS", "CALLS_ACTION", "CALLS_SERVICE")), depth)
    return hit.join(g.nodes.select("id", "name", "is_traced"), "id").select("id", "name", "depth", F.coalesce("is_traced", F.lit(False)).alias("is_traced"))


def context(g: PropertyGraph, what: str, cap: int = 1000) -> DataFrame:
    """``direction, type, id, name``: distinct neighbours each way, up to the cap each."""
    s = materialize(seeds_of(g, what).select("id"))

    def side(a: str, b: str, name: str) -> DataFrame:
        e = g.edges.join(s.withColumnRenamed("id", a), a, "left_semi").select("type", F.col(b).alias("id")).distinct()
        return e.join(g.nodes.select("id", "name"), "id").orderBy("type", "id").limit(cap).select(F.lit(name).alias("direction"), "type", "id", "name")

    return side("source_id", "target_id", "out").unionByName(side("target_id", "source_id", "in"))


def symbol_context(g: PropertyGraph, node_id: str) -> DataFrame:
    """One row: arrays of callers, callees, imports, imported_by, inherits, inherited_by."""
    e = g.edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    out, back = F.col("source_id") == node_id, F.col("target_id") == node_id
    kinds = {"callees": (out, "CALLS", "target_id"), "callers": (back, "CALLS", "source_id"), "imports": (out, "IMPORTS", "target_id"), "imported_by": (back, "IMPORTS", "source_id"), "inherits": (out, "INHERITS", "target_id"), "inherited_by": (back, "INHERITS", "source_id")}
    return e.agg(*[F.array_sort(F.collect_set(F.when(side & (F.col("type") == kind), F.col(c)))).alias(name) for name, (side, kind, c) in kinds.items()])


def changed_symbols(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Nodes whose lines overlap a changed range of their file: equi-join on the file, then the interval test."""
    h = hunks.select(F.col("file").alias("file_path"), F.coalesce("start", F.lit(0)).alias("h_start"), F.coalesce("end", F.lit(4294967295)).alias("h_end"))
    ok = (F.coalesce("start_line", F.lit(0)) <= F.col("h_end")) & (F.col("h_start") <= F.coalesce("end_line", F.lit(4294967295)))
    return nodes.join(h, "file_path").where(ok).select("id", "label", "name", "file_path").distinct()


def detect_changes(g: PropertyGraph, hunks: DataFrame, depth: int = 3) -> DataFrame:
    """One row: changed symbols, direct and transitive dependants, processes touched and the risk."""
    changed = materialize(changed_symbols(g.nodes, hunks))
    hit = materialize(bfs(changed.select(F.lit("change").alias("seed"), "id"), steps(g.edges, "in", CAUSAL), min(depth, 10)).join(g.nodes.select("id"), "id", "left_semi"))
    p = g.out_edges("STEP_IN_PROCESS").join(hit.select(F.col("id").alias("source_id")), "source_id", "left_semi").agg(F.countDistinct("target_id").alias("n_processes"))
    n = hit.agg(F.count_if(F.col("depth") == 0).alias("n_changed"), F.count_if(F.col("depth") == 1).alias("n_direct"), F.count_if(F.col("depth") > 0).alias("n_transitive"))
    return n.join(F.broadcast(p), F.lit(True)).withColumn("risk", risk(F.col("n_direct"), F.col("n_transitive"), F.col("n_processes")))


def endpoint_handler(g: PropertyGraph, method: str, route: str) -> DataFrame:
    """Handlers of endpoints by method and part of the route: HANDLED_BY edges, else ``handler_id``; with what they call."""
    e = g.label("ApiEndpoint").where((F.upper("http_method") == method.upper()) & F.lower("route").contains(route.lower()))
    by = g.out_edges("HANDLED_BY").select(F.col("source_id").alias("s_id"), F.col("target_id").alias("by_edge"))
    j = e.join(by, F.col("id") == F.col("s_id"), "left").select(F.col("id").alias("endpoint_id"), F.coalesce("by_edge", "handler_id").alias("id"))
    calls = g.out_edges("CALLS").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias("calls"))
    return j.join(g.nodes.select("id", "name", "file_path"), "id").join(calls, "id", "left")


def communities(g: PropertyGraph, part: str | None = None) -> DataFrame:
    """Communities with their number of members, or the members of the first whose name holds ``part``."""
    c, m = g.label("Community").select(F.col("id").alias("c_id"), F.col("name").alias("community")), g.out_edges("MEMBER_OF").select("source_id", F.col("target_id").alias("t_id"))
    if part is None:
        return c.join(m, F.col("c_id") == F.col("t_id"), "left").groupBy("c_id", "community").agg(F.count("source_id").alias("n_members"))
    first = c.where(F.lower("community").contains(part.lower())).orderBy("c_id").limit(1)
    return first.join(m, F.col("c_id") == F.col("t_id")).join(g.nodes, F.col("source_id") == F.col("id")).select("community", "id", "label", "name")


def process_steps(g: PropertyGraph, name: str | None = None) -> DataFrame:
    """``process_id, k, id, name``: steps of every process, or of those of one name, numbered anew in order."""
    e = g.out_edges("STEP_IN_PROCESS").select(F.col("target_id").alias("process_id"), F.col("source_id").alias("id"), "step")
    if name is not None:
        e = e.join(g.label("Process").where(F.col("name") == name).select(F.col("id").alias("process_id")), "process_id", "left_semi")
    k = F.row_number().over(Window.partitionBy("process_id").orderBy(F.asc_nulls_last("step"), "id"))
    return e.withColumn("k", k).join(g.nodes.select("id", "name"), "id").select("process_id", "k", "id", "name")


def rename_preview(g: PropertyGraph, files: DataFrame, node_id: str, old: str) -> DataFrame:
    """``file_path, line, text, confidence``: places where a name would change; the surest edit of a line counts.

    Definition 1.0; lines within a node that refers to the symbol 0.9; other lines that hold the word 0.5.
    """
    word = rf"\b{old}\b"
    lines = files.select("file_path", F.posexplode(F.split("content", "\r?\n")).alias("i", "text")).where(F.col("text").rlike(word)).select("file_path", (F.col("i") + 1).cast("long").alias("line"), "text")
    d = g.node(node_id).select(F.col("file_path"), F.col("start_line").alias("line"), F.lit(1.0).alias("confidence"))
    refs = g.edges.where((F.col("target_id") == node_id) & F.col("type").isin("CALLS", "IMPORTS", "USES", "EXTENDS", "IMPLEMENTS", "INHERITS", "OVERRIDES", "ACCESSES", "DECORATES")).select(F.col("source_id").alias("id")).distinct()
    near = g.nodes.join(refs, "id", "left_semi").select("file_path", F.coalesce("start_line", F.lit(0)).alias("a"), F.coalesce("end_line", F.lit(4294967295)).alias("z"))
    near = lines.join(near, "file_path").where(F.col("line").between(F.col("a"), F.col("z"))).select("file_path", "line", F.lit(0.9).alias("confidence"))
    sure = d.unionByName(near).groupBy("file_path", "line").agg(F.max("confidence").alias("confidence"))
    return lines.join(sure, ["file_path", "line"], "left").select("file_path", "line", "text", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def mermaid(g: PropertyGraph, node_id: str) -> DataFrame:
    """One row ``diagram``: a flowchart of what a symbol calls, or of its members if it calls nothing."""
    from codeloom.functions.kernels import mermaid_escape

    e = g.edges.where(F.col("source_id") == node_id)
    calls = e.where(F.col("type").isin("CALLS", "CALLS_ACTION", "CALLS_SERVICE"))
    members = e.where(F.col("type").isin("HAS_METHOD", "HAS_PROPERTY", "HAS_ACTION"))
    pick = members if is_empty(calls) else calls
    names = g.nodes.select(F.col("id").alias("target_id"), "name")
    lines = pick.select("target_id").distinct().join(names, "target_id").select(F.format_string('  A --> N%s["%s"]', F.hex(F.xxhash64("target_id")), mermaid_escape(F.col("name"))).alias("line"))
    head = g.node(node_id).select(F.format_string('flowchart TD\n  A["%s"]', mermaid_escape(F.col("name"))).alias("head"))
    body = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    return head.join(F.broadcast(body), F.lit(True)).select(F.concat_ws("\n", "head", F.when(F.col("body") != "", F.col("body"))).alias("diagram"))


