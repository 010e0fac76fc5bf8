"""Graph and change-history analytics: grouped aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.kernels import complexity_severity, layer_of, layer_order, module_of
from codeloom.graph import PropertyGraph

CALLABLE = ("Function", "Method", "Constructor")
CALL_TYPES = ("CALLS", "CALLS_ACTION", "CALLS_SERVICE")
COUPLING_MOST_FILES = 50
#: Methods that something outside the graph calls.
ENTRY_NAMES = ("Main", "main", "Dispose", "Application_Start", "Application_End", "Application_Error", "Application_BeginRequest", "Application_EndRequest", "Application_AuthenticateRequest", "Session_Start", "Session_End", "Configuration", "ConfigureServices", "Configure", "RegisterRoutes", "RegisterBundles", "RegisterGlobalFilters", "RegisterAreas", "OnAuthorization", "OnActionExecuting", "OnActionExecuted", "OnResultExecuting", "OnResultExecuted", "OnException")
#: Paths of tests and of view scripts.
TEST_PATH = r"(?i)[/\\]tests?[/\\]|\.tests?[/\\]|\.test\.|_test\.|[/\\]test\.(?:cs|js|ts)$|\.spec\.|_spec\."
VIEW_PATH = r"(?i)(?:\.cshtml|\.razor|#script-)(?!.*\.(?:cs|ts)$)|\.(?:jsx|vue)$|[/\\](?:obj|bin)[/\\]"


def label_counts(g: PropertyGraph) -> DataFrame:
    return g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def type_counts(g: PropertyGraph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def repo_overview(nodes: DataFrame) -> DataFrame:
    """Counts per repository."""
    return nodes.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("label") == "File").alias("n_files"), F.count_if(F.col("label").isin("Class", "Struct", "Interface")).alias("n_types"), F.count_if(F.col("label").isin(*CALLABLE)).alias("n_callables"),
        F.count_if(F.col("is_dead_candidate")).alias("n_dead"), F.count_if(F.col("is_traced")).alias("n_traced"), F.countDistinct("language").alias("n_languages"),
    )


def _at_rank(sorted_values: Column, n: Column, q: float) -> Column:
    """Nearest-rank quantile: position round((n - 1) q), halves away from zero."""
    return F.element_at(sorted_values, (F.round((n - 1) * q) + 1).cast("int"))


def complexity_report(nodes: DataFrame) -> DataFrame:
    """One row: n, avg, max, nearest-rank p50, p90, p99, and counts per severity, of callables with a complexity.

    Values are counted first: the list of distinct complexities is short whatever the number of callables.
    """
    c = nodes.where(F.col("label").isin(*CALLABLE) & F.col("complexity").isNotNull())
    hist = c.groupBy("complexity").agg(F.count(F.lit(1)).alias("k"))
    run = F.sum("k").over(Window.orderBy("complexity").rowsBetween(Window.unboundedPreceding, 0))
    h = hist.withColumn("upto", run).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = lambda q: F.min(F.when(F.col("upto") > F.round((F.col("n") - 1) * q), F.col("complexity")))
    sev = complexity_severity(F.col("complexity"))
    return h.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), (F.sum(F.col("complexity") * F.col("k")) / F.sum("k")).alias("avg_complexity"), F.max("complexity").alias("max_complexity"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"),
        *[F.coalesce(F.sum(F.when(sev == s, F.col("k"))), F.lit(0)).alias(f"n_{s}") for s in ("low", "moderate", "high", "critical")],
    )


def complex_callables(nodes: DataFrame, threshold: int = 10, limit: int = 20) -> DataFrame:
    c = nodes.where(F.col("label").isin(*CALLABLE) & (F.col("complexity") >= threshold))
    return c.select("id", "name", "file_path", "complexity", complexity_severity(F.col("complexity")).alias("severity")).orderBy(F.desc("complexity"), "id").limit(limit)


def module_complexity(nodes: DataFrame) -> DataFrame:
    c = nodes.where(F.col("label").isin(*CALLABLE) & F.col("complexity").isNotNull())
    return c.groupBy(module_of(F.col("file_path")).alias("module")).agg(F.count(F.lit(1)).alias("n"), F.avg("complexity").alias("avg_complexity"), F.max("complexity").alias("max_complexity"))


def coverage(nodes: DataFrame, *by: str) -> DataFrame:
    """Callables in all, traced and dead, and the traced share in whole per cent."""
    c = nodes.where(F.col("label").isin(*CALLABLE))
    a = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_traced")).alias("n_traced"), F.count_if(F.col("is_dead_candidate")).alias("n_dead"))
    return a.withColumn("pct", F.when(F.col("n") > 0, F.round(100.0 * F.col("n_traced") / F.col("n"))).otherwise(0.0).cast("long"))


def class_coverage(g: PropertyGraph) -> DataFrame:
    """Coverage of the methods of every class."""
    own = g.out_edges("HAS_METHOD").select("source_id", "target_id").distinct()
    j = own.join(g.nodes.select(F.col("id").alias("target_id"), "label", "is_traced", "is_dead_candidate"), "target_id").join(g.nodes.select(F.col("id").alias("source_id"), F.col("name").alias("class_name")), "source_id")
    return coverage(j.withColumn("class_id", F.col("source_id")), "class_id", "class_name")


def dead_code(g: PropertyGraph) -> DataFrame:
    """``id, name, file_path`` of methods and functions that nothing calls.

    Left out are entry names, tests, view scripts, methods of interfaces and methods with an action of the same name
    in their file.
    """
    called = g.out_edges(*CALL_TYPES).select(F.col("target_id").alias("id")).distinct()
    of_interface = g.out_edges("HAS_METHOD").join(g.label("Interface").select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    actions = g.nodes.where(F.col("label").isin("ControllerAction", "ApiEndpoint")).select("file_path", "name").distinct()
    c = g.nodes.where(F.col("label").isin("Method", "Function") & ~F.col("name").isin(*ENTRY_NAMES) & ~F.col("file_path").rlike(TEST_PATH) & ~((F.col("label") == "Function") & F.col("file_path").rlike(VIEW_PATH)))
    return c.join(called, "id", "left_anti").join(of_interface, "id", "left_anti").join(actions.withColumn("label", F.lit("Method")), ["file_path", "name", "label"], "left_anti").select("id", "name", "file_path")


def dead_methods(g: PropertyGraph, limit: int = 50) -> DataFrame:
    """Flagged methods with their class, by path; ``total`` is the number before the limit."""
    m = g.nodes.where(F.col("is_dead_candidate") & F.col("label").isin(*CALLABLE))
    owner = g.out_edges("HAS_METHOD").select(F.col("target_id").alias("id"), "source_id").join(g.nodes.select(F.col("id").alias("source_id"), F.col("name").alias("class_name")), "source_id").groupBy("id").agg(F.min("class_name").alias("class_name"))
    total = m.agg(F.count(F.lit(1)).alias("total"))
    return m.select("id", "name", "file_path").join(owner, "id", "left").join(F.broadcast(total), F.lit(True)).orderBy("file_path", "id").limit(limit)


def layer_violations(g: PropertyGraph, limit: int = 50) -> DataFrame:
    """Calls that skip a layer."""
    n = g.nodes.withColumn("layer", layer_of(F.col("label"), F.col("file_path"))).where("layer is not null").select("id", "name", "file_path", "layer")
    s, t = (n.select(*[F.col(c).alias(f"{p}_{c}") for c in n.columns]) for p in ("source", "target"))
    v = g.out_edges("CALLS", "CALLS_SERVICE").select("source_id", "target_id").distinct().join(s, "source_id").join(t, "target_id")
    v = v.where(layer_order(F.col("target_layer")) > layer_order(F.col("source_layer")) + 1)
    return v.select("source_id", "source_layer", "target_id", "target_layer").orderBy("source_id", "target_id").limit(limit)


def graph_diff(old: PropertyGraph, new: PropertyGraph, properties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, change, properties`` (added, removed, modified with the names of changed properties) and edges
    ``source_id, target_id, type, change``. One full outer join; rows that are equal in both drop out."""
    side = lambda g, p: g.nodes.select(F.col("id"), F.struct(*properties).alias(p))
    j = side(old, "a").join(side(new, "b"), "id", "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in properties]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "modified")
    nodes = j.select("id", change.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_sort(changed)).otherwise(F.array().cast("array<string>")).alias("properties")).where("change is not null")
    key = ["source_id", "target_id", "type"]
    a, b = old.edges.select(key).distinct(), new.edges.select(key).distinct()
    edges = b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))
    return nodes, edges


FLAGS = ("is_dead_candidate", "is_traced", "complexity", "entry_point_score")


def snapshot_summary(old: PropertyGraph, new: PropertyGraph) -> DataFrame:
    """``label, n_old, n_new, delta`` of every label in either graph; label null holds the totals."""
    c = old.nodes.select("label", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.nodes.select("label", F.lit(0).alias("o"), F.lit(1).alias("n")))
    r = c.rollup("label").agg(F.sum("o").alias("n_old"), F.sum("n").alias("n_new"))
    return r.select("label", "n_old", "n_new", (F.col("n_new") - F.col("n_old")).alias("delta"))


def flag_flips(old: PropertyGraph, new: PropertyGraph, most: int = 25) -> DataFrame:
    """``id, flags``: nodes of both graphs whose flags or measures changed, by id, the first ``most``."""
    flags = [f for f in FLAGS if f in old.nodes.columns and f in new.nodes.columns]
    j = old.nodes.select("id", F.struct(*flags).alias("a")).join(new.nodes.select("id", F.struct(*flags).alias("b")), "id")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in flags]))
    return j.select("id", changed.alias("flags")).where(F.size("flags") > 0).orderBy("id").limit(most)


# change history: commits are rows (commit, ts, author, email, file, added, removed)


def hotspots(commits: DataFrame) -> DataFrame:
    """Per file: commits, lines, churn, last change, authors, and commits x churn relative to the greatest."""
    a = commits.groupBy("file").agg(
        F.countDistinct("commit").alias("n_commits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max("ts").alias("last_change"), F.countDistinct("author").alias("n_authors")
    )
    a = a.withColumn("churn", F.col("added") + F.col("removed")).withColumn("raw", F.col("n_commits") * F.col("churn"))
    most = a.agg(F.max("raw").alias("most"))
    return a.join(F.broadcast(most), F.lit(True)).withColumn("score", F.when(F.col("most") > 0, F.col("raw") / F.col("most")).otherwise(0.0)).drop("raw", "most")


def coupling(commits: DataFrame, min_shared: int = 3, most_files: int = COUPLING_MOST_FILES) -> DataFrame:
    """``file_a, file_b, shared, strength``: files that change together.

    Commits of more files than ``most_files`` say nothing about pairs and are skipped, as in the reference; so a
    commit gives at most most_files squared pairs.
    """
    c = commits.select("commit", "file").distinct()
    per_file = c.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    small = c.join(c.groupBy("commit").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= most_files).select("commit"), "commit")
    files = small.groupBy("commit").agg(F.array_sort(F.collect_set("file")).alias("fs"))
    pairs = files.select(F.posexplode("fs").alias("i", "file_a"), "fs").select("file_a", F.explode(F.expr("slice(fs, i + 2, size(fs))")).alias("file_b"))
    p = pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    a, b = per_file.select(F.col("file").alias("file_a"), F.col("n").alias("n_a")), per_file.select(F.col("file").alias("file_b"), F.col("n").alias("n_b"))
    return p.join(a, "file_a").join(b, "file_b").select("file_a", "file_b", "shared", (F.col("shared") / F.greatest("n_a", "n_b")).alias("strength"))


def ownership(commits: DataFrame) -> DataFrame:
    """``file, primary_author, pct, n_authors``: who changes a file most; ties go to the least name."""
    a = commits.groupBy("file", "author").agg(F.countDistinct("commit").alias("k"))
    top = F.min(F.struct((-F.col("k")).alias("k"), F.col("author").alias("author")))
    o = a.groupBy("file").agg(top.alias("t"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_authors"))
    return o.select("file", F.col("t.author").alias("primary_author"), (100.0 * -F.col("t.k") / F.col("n")).alias("pct"), "n_authors")


def health(commits: DataFrame, variant: str = "mcp", nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """One row ``score, grade``; variants mcp, cli (adds a density bonus, whole numbers), desktop (weighted shares)."""
    h = hotspots(commits).agg(F.count_if(F.col("score") > 0.7).alias("n_hot"), F.count(F.lit(1)).alias("n_files"))
    c = coupling(commits).agg(F.count_if(F.col("strength") > 0.7).alias("n_coupled"))
    o = ownership(commits).agg(F.count_if(F.col("pct") < 50).alias("n_weak"))
    one = h.join(F.broadcast(c), F.lit(True)).join(F.broadcast(o), F.lit(True))
    if variant == "desktop":
        t = coverage(nodes).select(F.col("pct").alias("traced"))
        one = one.join(F.broadcast(t), F.lit(True))
        n = F.greatest(F.col("n_files"), F.lit(1))
        score = 30 * (1 - F.col("n_hot") / n) + 25.0 * (1 - F.least(F.col("n_coupled") / n, F.lit(1.0))) + 0.2 * F.col("traced") + 25 * (1 - F.col("n_weak") / n)
    else:
        score = 100.0 - 3 * F.col("n_hot") - 2 * F.col("n_coupled") - 0.5 * F.col("n_weak")
        if variant == "cli" and nodes is not None:
            d = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges"))), F.lit(True))
            one = one.join(F.broadcast(d), F.lit(True))
            density = F.col("n_edges") / F.greatest(F.col("n_nodes"), F.lit(1))
            score = score + F.when(density.between(1, 3), 5.0).otherwise(0.0)
    s = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 0 if variant == "cli" else 1)
    one = one.withColumn("score", s)
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("E")
    return one.select("n_hot", "n_coupled", "n_weak", "score", grade.alias("grade"))


def degrees(g: PropertyGraph) -> DataFrame:
    """``id, n_out, n_in``; counted at both ends in one pass, before the shuffle."""
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return g.edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def importance(g: PropertyGraph, limit: int = 200) -> DataFrame:
    """``id, name, label, importance`` of the most important nodes."""
    d = degrees(g)
    bonus = F.when(F.col("label").isin("Controller", "ControllerAction"), 20).when(F.col("label") == "Class", 10).when(F.col("label").isin("Service", "Repository"), 15).otherwise(0)
    entry = F.coalesce(F.col("entry_point_score"), F.lit(0.0)) if "entry_point_score" in g.nodes.columns else F.lit(0.0)
    score = 2.0 * (F.coalesce("n_in", F.lit(0)) + F.coalesce("n_out", F.lit(0))) + 10 * entry + F.when(F.col("is_exported"), 5).otherwise(0) + F.when(F.col("is_traced"), 3).otherwise(0) + bonus
    return g.nodes.join(d, "id", "left").select("id", "name", "label", score.cast("double").alias("importance")).orderBy(F.desc("importance"), "id").limit(limit)


def cohesion(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """``community, cohesion``: share of neighbour slots within the community; ``membership`` is ``id, community``."""
    e = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a <> b")
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ma, mb = membership.select(F.col("id").alias("a"), F.col("community").alias("ca")), membership.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    return both.join(ma, "a").join(mb, "b", "left").groupBy(F.col("ca").alias("community")).agg(F.avg(F.coalesce((F.col("ca") == F.col("cb")).cast("double"), F.lit(0.0))).alias("cohesion"))


def enrichment_priority(g: PropertyGraph, hot: DataFrame) -> DataFrame:
    """``id, priority``: hotspot, degree, size, untested and dead, weighted; below 0.05 left out."""
    d = degrees(g)
    j = g.nodes.join(d, "id", "left").join(hot.select(F.col("file").alias("file_path"), F.col("score").alias("hot")), "file_path", "left")
    lines = F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    p = 0.35 * F.coalesce("hot", F.lit(0.0)) + 0.25 * F.least((F.coalesce("n_in", F.lit(0)) + F.coalesce("n_out", F.lit(0))) / 20.0, F.lit(1.0)) + 0.2 * F.least(lines / 500.0, F.lit(1.0))
    p = p + F.when(~F.coalesce("is_traced", F.lit(False)), 0.1).otherwise(0.0) + F.when(F.coalesce("is_dead_candidate", F.lit(False)), 0.1).otherwise(0.0)
    return j.select("id", p.alias("priority")).where("priority >= 0.05")
