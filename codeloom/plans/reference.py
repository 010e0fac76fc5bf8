"""Queries of the property-graph engine itself, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import kernels
from codeloom.graph import code_graph, star_graph
from codeloom.lang.compile import run_query
from codeloom.operators import algorithms, analytics, etl, search, traverse, views
from codeloom.session import materialize, table
from codeloom.sources import interchange
from codeloom.streaming.watch import sessions, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NODES = "gn AS (SELECT * FROM (SELECT DISTINCT ON (id) * FROM nodes WHERE id IS NOT NULL ORDER BY id, indexed_at DESC, is_deleted) WHERE NOT coalesce(is_deleted, false))"
EDGES = "ge AS (SELECT DISTINCT id, source_id, target_id, rel_type AS type, confidence, reason, step FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"
GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}"
COMMITS = "c AS (SELECT o_orderkey AS commit, o_orderdate AS ts, o_custkey AS author, l_partkey AS file, l_quantity AS added, l_linenumber AS removed FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CALLABLE = "('Function', 'Method', 'Constructor')"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def cql(name: str, text: str, sql: str | None = None, graph: Callable = code_graph, **options) -> None:
    add(name, lambda spark, sf: run_query(graph(spark, sf), text, "cql", **options), sql)


def cypher(name: str, text: str, sql: str | None = None, graph: Callable = code_graph) -> None:
    add(name, lambda spark, sf: run_query(graph(spark, sf), text, "cypher"), sql)


# pattern language

cql(
    "cql_orders_of_customers", "MATCH (a:Order)-[:BELONGS_TO]->(c:Customer) WHERE c.name CONTAINS '7' RETURN c.name, a.id ORDER BY c.name, a.id",
    "SELECT c_name AS \"c.name\", 'Order:' || o_orderkey AS \"a.id\" FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(c_name, '7')", star_graph,
)
cql(
    "cql_two_hops", "MATCH (s:Supplier)-[:MEMBER_OF]->(n:Nation)-[:BELONGS_TO]->(r:Region) WHERE r.name = 'ASIA' RETURN s.name AS supplier, n.name AS nation",
    "SELECT s_name AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", star_graph,
)
cql(
    "cql_reverse_hop", "MATCH (p:Part {complexity: 7})<-[:CONTAINS]-(o:Order) RETURN p.id AS part, o.id AS ord",
    "SELECT DISTINCT 'Part:' || p_partkey AS part, 'Order:' || l_orderkey AS ord FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size = 7", star_graph,
)
cql(
    "cql_aggregates", "MATCH (m:Method) RETURN count(*) AS n, count(DISTINCT m.language) AS languages, sum(m.complexity) AS total, avg(m.complexity) AS mean, min(m.complexity) AS least, max(m.complexity) AS most",
    f"WITH {NODES} SELECT count(*) AS n, count(DISTINCT coalesce(language, 'null')) AS languages, coalesce(sum(complexity), 0)::DOUBLE AS total, sum(coalesce(complexity, 0))::DOUBLE / count(*) AS mean, min(complexity) AS least, max(complexity) AS most FROM gn WHERE label = 'Method'",
)
cql(
    "cql_grouped", "MATCH (c:Class)-[:HAS_METHOD]->(m:Method) RETURN c.language AS language, count(m) AS methods, max(m.complexity) AS most",
    f"{GRAPH} SELECT c.language, count(*) AS methods, max(m.complexity) AS most FROM (SELECT DISTINCT source_id, target_id FROM ge WHERE type = 'HAS_METHOD') e JOIN gn c ON c.id = source_id AND c.label = 'Class' JOIN gn m ON m.id = target_id AND m.label = 'Method' GROUP BY 1",
    implicit_grouping=True,
)
cql(
    "cql_predicates", "MATCH (n) WHERE (n.name STARTS WITH 'load' OR n.name ENDS WITH 'Ledger' OR n.name =~ 'Batch[A-Z]') AND NOT n.language IN ['go', 'rust'] AND n.complexity >= 3 RETURN n.id AS id, n.complexity + 1 AS c",
    f"WITH {NODES} SELECT id, complexity + 1 AS c FROM gn WHERE (starts_with(name, 'load') OR ends_with(name, 'Ledger') OR regexp_matches(name, 'Batch[A-Z]')) AND (language IS NULL OR language NOT IN ('go', 'rust')) AND complexity >= 3",
)
cql(
    "cql_undirected", "MATCH (a:File)-[:IMPORTS]-(b:File) RETURN a.id AS a, b.id AS b",
    f"{GRAPH}, i AS (SELECT source_id AS a, target_id AS b FROM ge WHERE type = 'IMPORTS'), u AS (SELECT a, b FROM i UNION SELECT b, a FROM i) SELECT u.a, u.b FROM u JOIN gn x ON x.id = u.a AND x.label = 'File' JOIN gn y ON y.id = u.b AND y.label = 'File'",
)
cql(
    "cql_closed_walk", "MATCH (a:Method)-[:CALLS]->(b:Method)-[:CALLS]->(a) RETURN a.id AS a, b.id AS b",
    f"{GRAPH}, k AS (SELECT DISTINCT source_id AS s, target_id AS t FROM ge WHERE type = 'CALLS') SELECT x.s AS a, x.t AS b FROM k x JOIN k y ON x.t = y.s AND x.s = y.t JOIN gn p ON p.id = x.s AND p.label = 'Method' JOIN gn q ON q.id = x.t AND q.label = 'Method'",
)
cql(
    "cql_shared_variable", "MATCH (f:File)-[:DEFINES]->(m:Method), (c:Class)-[:HAS_METHOD]->(m) RETURN f.id AS f, c.id AS c, m.id AS m",
    f"{GRAPH}, d AS (SELECT DISTINCT source_id AS f, target_id AS m FROM ge WHERE type = 'DEFINES'), h AS (SELECT DISTINCT source_id AS c, target_id AS m FROM ge WHERE type = 'HAS_METHOD') SELECT d.f, h.c, d.m FROM d JOIN h ON d.m = h.m JOIN gn x ON x.id = d.f AND x.label = 'File' JOIN gn y ON y.id = h.c AND y.label = 'Class' JOIN gn z ON z.id = d.m AND z.label = 'Method'",
)
cql(
    "cql_varlen", "MATCH (a:File)-[:IMPORTS*1..3]->(b:File) RETURN a.id AS a, b.id AS b",
    f"{GRAPH}, w(a, b, k) AS (SELECT source_id, target_id, 1 FROM ge WHERE type = 'IMPORTS' UNION SELECT w.a, e.target_id, k + 1 FROM w JOIN ge e ON e.source_id = w.b AND e.type = 'IMPORTS' WHERE k < 3) SELECT DISTINCT w.a, w.b FROM w JOIN gn x ON x.id = w.a AND x.label = 'File' JOIN gn y ON y.id = w.b AND y.label = 'File'",
    varlen=True,
)
cql(
    "cql_functions", "MATCH (c:Class) RETURN c.id AS id, toUpper(c.name) AS up, size(c.filePath) AS n, coalesce(c.language, 'none') AS language, toString(c.startLine) AS line",
    f"WITH {NODES} SELECT id, upper(name) AS up, strlen(file_path)::BIGINT AS n, coalesce(language, 'none') AS language, coalesce(start_line::VARCHAR, 'null') AS line FROM gn WHERE label = 'Class'",
)
cql("cql_call", "CALL QUERY_FTS_INDEX('File', 'ledger')", f"WITH {NODES} SELECT id, name, label, file_path FROM gn WHERE contains(lower(name), 'ledger')")
cypher(
    "cypher_hop", "MATCH (a:Method)-[:CALLS]->(b) WHERE a.language = 'python' AND NOT b.name CONTAINS 'Ledger' RETURN a.id, b.name",
    f"{GRAPH} SELECT a.id AS \"a.id\", b.name AS \"b.name\" FROM ge e JOIN gn a ON a.id = source_id AND a.label = 'Method' AND a.language = 'python' LEFT JOIN gn b ON b.id = target_id WHERE type = 'CALLS' AND NOT coalesce(contains(b.name, 'Ledger'), false)",
)
cypher("cypher_count", "MATCH (a:File)-[:IMPORTS]->(b:File) RETURN count(b)", f"{GRAPH} SELECT count(*) AS count FROM ge JOIN gn a ON a.id = source_id AND a.label = 'File' JOIN gn b ON b.id = target_id AND b.label = 'File' WHERE type = 'IMPORTS'")
cypher("cypher_distinct", "MATCH (m:Method) WHERE m.isExported = 'true' OR m.complexity = 3 RETURN DISTINCT m.language, m.complexity", f"WITH {NODES} SELECT DISTINCT language AS \"m.language\", complexity AS \"m.complexity\" FROM gn WHERE label = 'Method' AND (is_exported OR complexity = 3)")
cypher(
    "cypher_ordered", "MATCH (m:Method) RETURN m.id, m.complexity ORDER BY m.id DESC LIMIT 25",
    f"WITH {NODES} SELECT id AS \"m.id\", complexity AS \"m.complexity\" FROM gn WHERE label = 'Method' ORDER BY id DESC LIMIT 25",
)
cypher("cypher_nodes", "MATCH (c:Struct) RETURN c")

# search

_DOC_QUERY = "nightly snapshot interface locker"


def _bm25_sql(docs: str, key: str, text: str, query: str, weight: str = "1.0") -> str:
    terms = search.query_terms(query)
    tf = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in terms]
    part = " + ".join(f"{n} * greatest(0, ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1)) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * len(w) / avgdl))" for i, (f, n) in enumerate(zip(tf, terms.values())))
    return f"""bd AS (SELECT *, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {docs}),
bs AS (SELECT count(*) AS n, greatest(1.0, sum(len(w)) / count(*)) AS avgdl, {', '.join(f"count(*) FILTER (list_contains(w, '{t}')) AS d{i}" for i, t in enumerate(terms))} FROM bd),
bm AS (SELECT bd.* EXCLUDE (w), ({part}) * {weight} AS score FROM bd, bs WHERE {' OR '.join(f"list_contains(w, '{t}')" for t in terms)})"""


add(
    "bm25_documents", lambda s, f: search.bm25(table(s, f, "documents"), "doc_id", F.col("text"), _DOC_QUERY).select("doc_id", F.round("score", 6).alias("score")),
    f"WITH {_bm25_sql('documents', 'doc_id', 'text', _DOC_QUERY)} SELECT doc_id, round(score, 6) AS score FROM bm",
)
_INDEXED = ", ".join(f"'{x}'" for x in search.INDEXED)
_WEIGHT = "(CASE WHEN regexp_matches(lower(file_path), '\\.min\\.js|\\.min\\.css|\\.min\\.map|-min\\.js|-min\\.css|-vsdoc\\.js|\\.vsdoc\\.js|\\.designer\\.cs|\\.g\\.cs|\\.g\\.i\\.cs|scripts/(jquery|knockout|kendo|telerik|angular|bootstrap|modernizr|moment|history)|(^|[/\\\\])(packages|node_modules|bower_components|vendor|obj|bin)([/\\\\]|$)|wwwroot[/\\\\]lib[/\\\\]') THEN 0.1 ELSE 1.0 END * CASE WHEN label IN ('Class', 'Method', 'Function') THEN 1.5 ELSE 1.0 END)"
_NODE_BM = _bm25_sql(f"(SELECT * FROM gn WHERE label IN ({_INDEXED})) q", "id", "concat_ws(' ', name, file_path, description)", "ledger mapper billing", _WEIGHT)
add(
    "bm25_nodes", lambda s, f: search.bm25_nodes(code_graph(s, f).nodes, "ledger mapper billing", limit=50).select("rank", "id", F.round("score", 6).alias("score")),
    f"WITH {NODES}, {_NODE_BM} SELECT row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank, id, round(score, 6) AS score FROM bm ORDER BY 1 LIMIT 50",
)
add("search_files", lambda s, f: search.search_files(code_graph(s, f).nodes, "ledger mapper billing", 30).select("rank", "file_path", "node_id", F.round("score", 6).alias("score")))
add("search_code", lambda s, f: search.search_code((g := code_graph(s, f)).nodes, g.edges, "ledger mapper", 10).select("rank", "id", F.round("score", 6).alias("score"), "calls", "called_by"))
add("embedding_text", lambda s, f: search.embedding_text(code_graph(s, f).nodes), f"WITH {NODES} SELECT id AS node_id, concat_ws(' ', name, file_path, description) AS text FROM gn WHERE file_path IS NULL OR NOT regexp_matches(file_path, '(?i)(?:^|/)(?:obj|bin|node_modules|packages)/|\\.min\\.')")
add(
    "semantic_batch", lambda s, f: search.semantic_batch(e := table(s, f, "embeddings"), e.where("vec_id % 100 = 0"), "vec_id", 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score")),
    "WITH s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))), 12) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM k WHERE rank <= 10",
)


def _fused(s: SparkSession, f: str) -> DataFrame:
    d, e = table(s, f, "documents"), table(s, f, "embeddings")
    words = search.top(search.bm25(d, "doc_id", F.col("text"), _DOC_QUERY).select(F.col("doc_id").alias("node_id"), F.round("score", 9).alias("score")), 20, "node_id")
    first = e.where("vec_id = 0").first()["embedding"]
    near = search.semantic(e, "vec_id", list(first), 20).withColumnRenamed("vec_id", "node_id")
    return search.fuse(("bm25", words), ("semantic", near), limit=30).select("rank", "node_id", F.round("score", 9).alias("score"), F.array_join("sources", "+").alias("sources"))


add(
    "rank_fusion", _fused,
    f"""WITH {_bm25_sql('documents', 'doc_id', 'text', _DOC_QUERY)},
a AS (SELECT doc_id AS node_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm QUALIFY r <= 20),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
b AS (SELECT vec_id AS node_id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))) DESC, vec_id) AS r FROM embeddings, q QUALIFY r <= 20),
u AS (SELECT node_id, 1.0::DOUBLE / (60 + r) AS p, 'bm25' AS s FROM a UNION ALL SELECT node_id, 1.0::DOUBLE / (60 + r), 'semantic' FROM b),
g AS (SELECT node_id, sum(p) AS score, string_agg(s, '+' ORDER BY s) AS sources FROM u GROUP BY 1)
SELECT row_number() OVER (ORDER BY score DESC, node_id) AS rank, node_id, round(score, 9) AS score, sources FROM g QUALIFY rank <= 30""",
)

# aggregates over the graph

add("label_counts", lambda s, f: analytics.label_counts(code_graph(s, f)), f"WITH {NODES} SELECT label, count(*) AS n FROM gn GROUP BY 1")
add("type_counts", lambda s, f: analytics.type_counts(code_graph(s, f)), f"WITH {EDGES} SELECT type, count(*) AS n FROM ge GROUP BY 1")
add(
    "repo_overview", lambda s, f: analytics.repo_overview(code_graph(s, f).nodes),
    f"WITH {NODES} SELECT repo, count(*) AS n_nodes, count(*) FILTER (label = 'File') AS n_files, count(*) FILTER (label IN ('Class', 'Struct', 'Interface')) AS n_types, count(*) FILTER (label IN {CALLABLE}) AS n_callables, count(*) FILTER (is_dead_candidate) AS n_dead, count(*) FILTER (is_traced) AS n_traced, count(DISTINCT language) AS n_languages FROM gn GROUP BY 1",
)
_SEV = "CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'high' ELSE 'critical' END"
add(
    "complexity_report", lambda s, f: analytics.complexity_report(code_graph(s, f).nodes),
    f"WITH {NODES}, l AS (SELECT list(complexity ORDER BY complexity) AS v, count(*) AS n FROM gn WHERE label IN {CALLABLE} AND complexity IS NOT NULL) SELECT n, list_avg(v) AS avg_complexity, list_max(v) AS max_complexity, v[1 + round((n - 1) * 0.5)::INT] AS p50, v[1 + round((n - 1) * 0.9)::INT] AS p90, v[1 + round((n - 1) * 0.99)::INT] AS p99, len(list_filter(v, lambda x: x <= 5)) AS n_low, len(list_filter(v, lambda x: x > 5 AND x <= 10)) AS n_moderate, len(list_filter(v, lambda x: x > 10 AND x <= 20)) AS n_high, len(list_filter(v, lambda x: x > 20)) AS n_critical FROM l",
)
add("complex_callables", lambda s, f: analytics.complex_callables(code_graph(s, f).nodes, 10, 20), f"WITH {NODES} SELECT id, name, file_path, complexity, {_SEV} AS severity FROM gn WHERE label IN {CALLABLE} AND complexity >= 10 ORDER BY complexity DESC, id LIMIT 20")
_MODULE = "CASE WHEN len(string_split(file_path, '/')) > 1 AND NOT contains(string_split(file_path, '/')[2], '.') THEN string_split(file_path, '/')[1] || '/' || string_split(file_path, '/')[2] ELSE string_split(file_path, '/')[1] END"
add("module_complexity", lambda s, f: analytics.module_complexity(code_graph(s, f).nodes), f"WITH {NODES} SELECT {_MODULE} AS module, count(*) AS n, avg(complexity) AS avg_complexity, max(complexity) AS max_complexity FROM gn WHERE label IN {CALLABLE} AND complexity IS NOT NULL GROUP BY 1")
_COVER = "count(*) AS n, count(*) FILTER (is_traced) AS n_traced, count(*) FILTER (is_dead_candidate) AS n_dead, round(100.0 * count(*) FILTER (is_traced) / count(*))::BIGINT AS pct"
add("coverage_by_repo", lambda s, f: analytics.coverage(code_graph(s, f).nodes, "repo"), f"WITH {NODES} SELECT repo, {_COVER} FROM gn WHERE label IN {CALLABLE} GROUP BY 1")
add(
    "class_coverage", lambda s, f: analytics.class_coverage(code_graph(s, f)),
    f"{GRAPH}, j AS (SELECT o.id AS class_id, o.name AS class_name, m.* FROM (SELECT DISTINCT source_id, target_id FROM ge WHERE type = 'HAS_METHOD') e JOIN gn m ON m.id = target_id AND m.label IN {CALLABLE} JOIN gn o ON o.id = source_id) SELECT class_id, class_name, {_COVER} FROM j GROUP BY 1, 2",
)
_ENTRY = ", ".join(f"'{x}'" for x in analytics.ENTRY_NAMES)
add(
    "dead_code", lambda s, f: analytics.dead_code(code_graph(s, f)),
    f"{GRAPH} SELECT id, name, file_path FROM gn WHERE label IN ('Method', 'Function') AND name NOT IN ({_ENTRY}) AND NOT regexp_matches(file_path, '(?i)[/\\\\]tests?[/\\\\]|\\.tests?[/\\\\]|\\.test\\.|_test\\.|[/\\\\]test\\.(cs|js|ts)$|\\.spec\\.|_spec\\.') AND NOT (label = 'Function' AND regexp_matches(file_path, '(?i)\\.(jsx|vue)$|[/\\\\](obj|bin)[/\\\\]')) AND id NOT IN (SELECT target_id FROM ge WHERE type IN ('CALLS', 'CALLS_ACTION', 'CALLS_SERVICE'))",
)
add(
    "dead_methods", lambda s, f: analytics.dead_methods(code_graph(s, f)),
    f"{GRAPH}, d AS (SELECT id, name, file_path FROM gn WHERE is_dead_candidate AND label IN {CALLABLE}), o AS (SELECT target_id AS id, min(c.name) AS class_name FROM ge JOIN gn c ON c.id = source_id WHERE type = 'HAS_METHOD' GROUP BY 1) SELECT d.*, class_name, (SELECT count(*) FROM d) AS total FROM d LEFT JOIN o ON d.id = o.id ORDER BY file_path, d.id LIMIT 50",
)
_LAYER = "CASE WHEN contains(lower(file_path), 'controller') OR contains(lower(file_path), '/views/') THEN 'Presentation' WHEN regexp_matches(lower(file_path), 'service|/bal/|/bll/') THEN 'Business' WHEN regexp_matches(lower(file_path), 'repository|/dal/|entities|dbcontext') THEN 'Data' END"
add(
    "layer_violations", lambda s, f: analytics.layer_violations(code_graph(s, f)),
    f"{GRAPH}, l AS (SELECT id, {_LAYER} AS layer FROM gn) SELECT DISTINCT source_id, a.layer AS source_layer, target_id, b.layer AS target_layer FROM ge JOIN l a ON a.id = source_id JOIN l b ON b.id = target_id WHERE type IN ('CALLS', 'CALLS_SERVICE') AND a.layer = 'Presentation' AND b.layer = 'Data' ORDER BY 1, 3 LIMIT 50",
)
_DIFF = ["name", "complexity", "is_exported", "is_traced", "language", "return_type"]
_UNTIL = "2025-07-01"
_OLD = NODES.replace("gn AS", "go AS").replace("id IS NOT NULL", f"id IS NOT NULL AND indexed_at <= TIMESTAMPTZ '{_UNTIL} 00:00:00+00'")
add(
    "snapshot_diff_nodes", lambda s, f: analytics.graph_diff(code_graph(s, f, _UNTIL), code_graph(s, f), _DIFF)[0].withColumn("properties", F.array_join("properties", ",")),
    f"WITH {NODES}, {_OLD}, j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN a.id IS NULL OR b.id IS NULL THEN [] ELSE list_sort(list_filter([{', '.join(f'CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN {chr(39)}{c}{chr(39)} END' for c in _DIFF)}], lambda x: x IS NOT NULL)) END AS p FROM go a FULL JOIN gn b ON a.id = b.id) SELECT id, change, array_to_string(p, ',') AS properties FROM j WHERE change <> 'modified' OR len(p) > 0",
)
add(
    "snapshot_diff_edges", lambda s, f: analytics.graph_diff(code_graph(s, f, _UNTIL), code_graph(s, f), _DIFF)[1],
    f"WITH {EDGES}, a AS (SELECT DISTINCT source_id, target_id, type FROM ge), b AS (SELECT DISTINCT source_id, target_id, rel_type AS type FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND recorded_at <= TIMESTAMPTZ '{_UNTIL} 00:00:00+00') SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
)
_DEG = "d AS (SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM ge UNION ALL SELECT target_id, 0, 1 FROM ge) GROUP BY 1)"
add("degrees", lambda s, f: analytics.degrees(code_graph(s, f)), f"WITH {EDGES}, {_DEG} SELECT * FROM d")
add(
    "importance", lambda s, f: analytics.importance(code_graph(s, f)),
    f"WITH {NODES}, {EDGES}, {_DEG} SELECT gn.id, name, label, (2.0 * (coalesce(n_in, 0) + coalesce(n_out, 0)) + CASE WHEN is_exported THEN 5 ELSE 0 END + CASE WHEN is_traced THEN 3 ELSE 0 END + CASE label WHEN 'Class' THEN 10 ELSE 0 END)::DOUBLE AS importance FROM gn LEFT JOIN d ON gn.id = d.id ORDER BY importance DESC, gn.id LIMIT 200",
)
add(
    "cohesion", lambda s, f: analytics.cohesion((g := code_graph(s, f)).nodes.where("communities is not null and size(communities) > 0").select("id", F.col("communities")[0].alias("community")), g.edges).select("community", F.round("cohesion", 9).alias("cohesion")),
    f"WITH {NODES}, {EDGES}, m AS (SELECT id, communities[1] AS c FROM gn WHERE len(communities) > 0), e AS (SELECT source_id AS a, target_id AS b FROM ge WHERE source_id <> target_id), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT x.c AS community, round(avg(CASE WHEN x.c = y.c THEN 1.0 ELSE 0.0 END), 9) AS cohesion FROM u JOIN m x ON x.id = u.a LEFT JOIN m y ON y.id = u.b GROUP BY 1",
)

# change history: orders are commits, parts are files


def commits(s: SparkSession, f: str) -> DataFrame:
    l, o = table(s, f, "lineitem"), table(s, f, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("author"), F.col("l_partkey").alias("file"), F.col("l_quantity").alias("added"), F.col("l_linenumber").alias("removed"))


_HOT = "h AS (SELECT file, count(DISTINCT commit) AS n_commits, sum(added) AS added, sum(removed)::BIGINT AS removed, max(ts) AS last_change, count(DISTINCT author) AS n_authors, sum(added) + sum(removed) AS churn FROM c GROUP BY 1), hs AS (SELECT *, n_commits * churn / max(n_commits * churn) OVER () AS score FROM h)"
_COUP = "cf AS (SELECT DISTINCT commit, file FROM c), fn AS (SELECT file, count(*) AS n FROM cf GROUP BY 1), sm AS (SELECT commit FROM cf GROUP BY 1 HAVING count(*) <= 50), pr AS (SELECT x.file AS file_a, y.file AS file_b, count(*) AS shared FROM cf x JOIN cf y ON x.commit = y.commit AND x.file < y.file WHERE x.commit IN (SELECT commit FROM sm) GROUP BY 1, 2 HAVING count(*) >= {m}), cp AS (SELECT pr.*, shared / greatest(a.n, b.n) AS strength FROM pr JOIN fn a ON a.file = file_a JOIN fn b ON b.file = file_b)"
_OWN = "ow AS (SELECT file, author, count(DISTINCT commit) AS k FROM c GROUP BY 1, 2), oo AS (SELECT file, author AS primary_author, 100.0 * k / sum(k) OVER (PARTITION BY file) AS pct, count(*) OVER (PARTITION BY file) AS n_authors FROM ow QUALIFY row_number() OVER (PARTITION BY file ORDER BY k DESC, author) = 1)"
add("hotspots", lambda s, f: analytics.hotspots(commits(s, f)).withColumn("score", F.round("score", 9)), f"WITH {COMMITS}, {_HOT} SELECT * REPLACE (round(score, 9) AS score) FROM hs")
add("coupling", lambda s, f: analytics.coupling(commits(s, f), 2).withColumn("strength", F.round("strength", 9)), f"WITH {COMMITS}, {_COUP.format(m=2)} SELECT file_a, file_b, shared, round(strength, 9) AS strength FROM cp")
add("ownership", lambda s, f: analytics.ownership(commits(s, f)).withColumn("pct", F.round("pct", 9)), f"WITH {COMMITS}, {_OWN} SELECT file, primary_author, round(pct, 9) AS pct, n_authors FROM oo")
_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade"
add(
    "health", lambda s, f: analytics.health(commits(s, f)),
    f"WITH {COMMITS}, {_HOT}, {_COUP.format(m=3)}, {_OWN}, q AS (SELECT (SELECT count(*) FROM hs WHERE score > 0.7) AS n_hot, (SELECT count(*) FROM cp WHERE strength > 0.7) AS n_coupled, (SELECT count(*) FROM oo WHERE pct < 50) AS n_weak), z AS (SELECT *, round(least(100.0, greatest(0.0, 100.0 - 3 * n_hot - 2 * n_coupled - 0.5 * n_weak)), 1)::DOUBLE AS score FROM q) SELECT *, {_GRADE} FROM z",
)

# traversals

_NAME = "openBooking"
_CAUSAL = ", ".join(f"'{x}'" for x in traverse.CAUSAL)


def _bfs_sql(moves: str, depth: int) -> str:
    return f"{GRAPH}, mv AS ({moves}), w(id, depth) AS (SELECT id, 0 FROM gn WHERE lower(name) = lower('{_NAME}') UNION SELECT mv.b, depth + 1 FROM w JOIN mv ON mv.a = w.id WHERE depth < {depth}), r AS (SELECT id, min(depth) AS depth FROM w GROUP BY 1)"


add("impact_upstream", lambda s, f: traverse.impact(code_graph(s, f), _NAME, "upstream", 3), _bfs_sql(f"SELECT DISTINCT target_id AS a, source_id AS b FROM ge WHERE type IN ({_CAUSAL})", 3) + " SELECT id, label, name, file_path, depth FROM r JOIN gn USING (id) WHERE depth > 0")
add("impact_downstream", lambda s, f: traverse.impact(code_graph(s, f), _NAME, "downstream", 2), _bfs_sql(f"SELECT DISTINCT source_id AS a, target_id AS b FROM ge WHERE type IN ({_CAUSAL})", 2) + " SELECT id, label, name, file_path, depth FROM r JOIN gn USING (id) WHERE depth > 0")
add(
    "impact_paths", lambda s, f: traverse.impact_paths(g := code_graph(s, f), g.nodes.where(F.lower("name") == _NAME.lower()).agg(F.min("id")).first()[0], "upstream", 3).withColumn("path", F.array_join("path", " ")),
    f"{GRAPH}, mv AS (SELECT DISTINCT target_id AS a, source_id AS b FROM ge WHERE type IN ({_CAUSAL})), w(id, depth, path) AS (SELECT id, 0, [id] FROM (SELECT min(id) AS id FROM gn WHERE lower(name) = lower('{_NAME}')) UNION SELECT mv.b, depth + 1, list_append(path, mv.b) FROM w JOIN mv ON mv.a = w.id WHERE depth < 3), r AS (SELECT id, min((depth, path)) AS r FROM w GROUP BY 1) SELECT id, label, name, file_path, r[1] AS depth, array_to_string(r[2], ' ') AS path FROM r JOIN gn USING (id) WHERE r[1] > 0",
)
add("neighbours", lambda s, f: traverse.neighbours(code_graph(s, f), _NAME, 2), _bfs_sql("SELECT source_id AS a, target_id AS b FROM ge UNION SELECT target_id, source_id FROM ge", 2) + " SELECT id, label, name, depth FROM r JOIN gn USING (id) WHERE depth > 0")
add("trace_files", lambda s, f: traverse.trace_files(code_graph(s, f), _NAME, 3), _bfs_sql("SELECT DISTINCT source_id AS a, target_id AS b FROM ge WHERE type NOT IN ('HAS_METHOD', 'HAS_PROPERTY')", 3) + " SELECT file_path, count(*) AS n_symbols, min(depth) AS depth FROM r JOIN gn USING (id) GROUP BY 1")
add(
    "context", lambda s, f: traverse.context(code_graph(s, f), _NAME, 1 << 30),
    f"{GRAPH}, q AS (SELECT id FROM gn WHERE lower(name) = lower('{_NAME}')) SELECT DISTINCT 'out' AS direction, type, n.id, n.name FROM ge JOIN gn n ON n.id = target_id WHERE source_id IN (SELECT id FROM q) UNION ALL SELECT DISTINCT 'in', type, n.id, n.name FROM ge JOIN gn n ON n.id = source_id WHERE target_id IN (SELECT id FROM q)",
)


def _path(s: SparkSession, f: str) -> DataFrame:
    """From the first customer to the supplier of the greatest key of another nation in its region."""
    c, n, u = table(s, f, "customer"), table(s, f, "nation"), table(s, f, "supplier")
    home = c.orderBy("c_custkey").limit(1).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("r"))
    goal = u.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(home), (F.col("n_regionkey") == F.col("r")) & (F.col("s_nationkey") != F.col("c_nationkey"))).agg(F.max("s_suppkey").alias("s"), F.min("c_custkey").alias("c")).first()
    found = traverse.shortest_path(star_graph(s, f), f"Customer:{goal['c']}", f"Supplier:{goal['s']}", ("MEMBER_OF", "BELONGS_TO"), directed=False)
    return found.select("depth", F.array_join("path", " ").alias("path"))


add(
    "shortest_path", _path,
    "WITH h AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 1), g AS (SELECT s_suppkey, s_nationkey, h.* FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN h ON n.n_regionkey = h.n_regionkey AND s_nationkey <> c_nationkey ORDER BY s_suppkey DESC LIMIT 1) SELECT 4 AS depth, 'Customer:' || c_custkey || ' Nation:' || c_nationkey || ' Region:' || n_regionkey || ' Nation:' || s_nationkey || ' Supplier:' || s_suppkey AS path FROM g",
)
add(
    "subgraph", lambda s, f: traverse.subgraph(star_graph(s, f), "Region:0", 2, 500)[0],
    "WITH w AS (SELECT 'Region:0' AS id, 0 AS depth UNION ALL SELECT 'Nation:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'Customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 'Supplier:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0) SELECT * FROM w ORDER BY depth, id LIMIT 500",
)

# algorithms

add(
    "import_cycles", lambda s, f: algorithms.cycles(code_graph(s, f), "imports").select("component", "length", "severity", F.array_join("members", ",").alias("members")),
    f"{GRAPH}, fl AS (SELECT id FROM gn WHERE label = 'File'), i AS (SELECT DISTINCT source_id AS a, target_id AS b FROM ge WHERE type = 'IMPORTS' AND source_id IN (SELECT id FROM fl) AND target_id IN (SELECT id FROM fl)), r(a, b) AS (SELECT a, b FROM i UNION SELECT r.a, i.b FROM r JOIN i ON r.b = i.a), m AS (SELECT x.a AS id, list_sort(list(DISTINCT x.b)) AS ms FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT DISTINCT ms[1] AS component, len(ms) AS length, CASE WHEN len(ms) <= 3 THEN 'low' WHEN len(ms) <= 6 THEN 'medium' ELSE 'high' END AS severity, array_to_string(ms, ',') AS members FROM m",
)
add(
    "call_cycles", lambda s, f: algorithms.cycles(code_graph(s, f), "calls").select("component", "length", "severity", F.array_join("members", ",").alias("members")),
    f"{GRAPH}, fl AS (SELECT id FROM gn WHERE label IN {CALLABLE}), i AS (SELECT DISTINCT source_id AS a, target_id AS b FROM ge WHERE type = 'CALLS' AND source_id IN (SELECT id FROM fl) AND target_id IN (SELECT id FROM fl)), r(a, b) AS (SELECT a, b FROM i UNION SELECT r.a, i.b FROM r JOIN i ON r.b = i.a), m AS (SELECT x.a AS id, list_sort(list(DISTINCT x.b)) AS ms FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT DISTINCT ms[1] AS component, len(ms) AS length, CASE WHEN len(ms) <= 3 THEN 'low' WHEN len(ms) <= 6 THEN 'medium' ELSE 'high' END AS severity, array_to_string(ms, ',') AS members FROM m",
)
add("short_cycles", lambda s, f: algorithms.short_cycles(code_graph(s, f)).select("length", F.array_join("members", ",").alias("members")))
add(
    "import_levels", lambda s, f: algorithms.levels((g := code_graph(s, f)).out_edges("IMPORTS").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), g.label("File")),
    f"{GRAPH}, fl AS (SELECT id FROM gn WHERE label = 'File'), i AS (SELECT DISTINCT source_id AS a, target_id AS b FROM ge WHERE type = 'IMPORTS' AND source_id <> target_id AND source_id IN (SELECT id FROM fl) AND target_id IN (SELECT id FROM fl)), r(a, b) AS (SELECT a, b FROM i UNION SELECT r.a, i.b FROM r JOIN i ON r.b = i.a), bad AS (SELECT DISTINCT r.a AS id FROM r JOIN r c ON c.a = r.b AND c.a = c.b UNION SELECT a FROM r WHERE a = b), w(id, k) AS (SELECT id, 0 FROM fl WHERE id NOT IN (SELECT a FROM i) UNION SELECT i.a, k + 1 FROM w JOIN i ON i.b = w.id WHERE i.a NOT IN (SELECT id FROM bad)), l AS (SELECT id, max(k) AS level FROM w GROUP BY 1) SELECT * FROM l UNION ALL SELECT id, coalesce((SELECT max(level) + 1 FROM l), 0) FROM bad",
)
add("clone_clusters", lambda s, f: algorithms.clone_clusters(table(s, f, "source_files").select(F.col("file_id").cast("string").alias("id"), F.col("content").alias("text"))))
add("snapshot_summary", lambda s, f: analytics.snapshot_summary(code_graph(s, f, _UNTIL), code_graph(s, f)), f"WITH {NODES}, {_OLD}, c AS (SELECT label, 1 AS o, 0 AS n FROM go UNION ALL SELECT label, 0, 1 FROM gn) SELECT label, sum(o)::BIGINT AS n_old, sum(n)::BIGINT AS n_new, (sum(n) - sum(o))::BIGINT AS delta FROM c GROUP BY ROLLUP (label)")
add(
    "flag_flips", lambda s, f: analytics.flag_flips(code_graph(s, f, _UNTIL), code_graph(s, f)).withColumn("flags", F.array_join("flags", ",")),
    f"WITH {NODES}, {_OLD}, j AS (SELECT gn.id, array_to_string(list_filter([CASE WHEN go.is_dead_candidate IS DISTINCT FROM gn.is_dead_candidate THEN 'is_dead_candidate' END, CASE WHEN go.is_traced IS DISTINCT FROM gn.is_traced THEN 'is_traced' END, CASE WHEN go.complexity IS DISTINCT FROM gn.complexity THEN 'complexity' END], lambda x: x IS NOT NULL), ',') AS flags FROM go JOIN gn ON go.id = gn.id) SELECT id, flags FROM j WHERE flags <> '' ORDER BY id LIMIT 25",
)
add(
    "name_scores", lambda s, f: code_graph(s, f).nodes.where(F.col("label").isin("Method", "Function")).select("name", kernels.name_score(F.col("name")).alias("score")).where("score is not null").distinct(),
    f"WITH {NODES}, s AS (SELECT DISTINCT name, CASE lower(name) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in kernels.ENTRY_SCORES.items())} ELSE CASE {' '.join(f'WHEN regexp_matches(name, {chr(39)}^(?i:{k})(?:_|[A-Z]){chr(39)}) THEN {v}' for part in (kernels.HANDLER_SCORES, kernels.HELPER_SCORES) for k, v in part.items())} END END::DOUBLE AS score FROM gn WHERE label IN ('Method', 'Function')) SELECT name, score FROM s WHERE score IS NOT NULL",
)
add("communities", lambda s, f: algorithms.communities(code_graph(s, f)))
_LIFT = f"cl AS (SELECT id FROM gn WHERE label IN {CALLABLE}), k0 AS (SELECT source_id AS a, target_id AS b FROM ge WHERE type = 'CALLS' UNION SELECT d.target_id, c.target_id FROM ge c JOIN ge d ON c.source_id = d.source_id AND d.type = 'DEFINES' WHERE c.type = 'CALLS'), k AS (SELECT DISTINCT a, b FROM k0 WHERE a <> b AND a IN (SELECT id FROM cl) AND b IN (SELECT id FROM cl))"
add("lifted_calls", lambda s, f: algorithms.lifted_calls(code_graph(s, f)), f"{GRAPH}, {_LIFT} SELECT a, b FROM k")
add(
    "entry_points", lambda s, f: algorithms.entry_points(code_graph(s, f)),
    f"{GRAPH}, {_LIFT}, o AS (SELECT a AS id, count(*) AS n FROM k GROUP BY 1), i AS (SELECT b AS id, count(*) AS n FROM k GROUP BY 1) SELECT gn.id, round((CASE WHEN is_exported THEN 3.0 ELSE 0.0 END + CASE WHEN i.n IS NULL THEN 5.0 ELSE 2.0::DOUBLE / i.n END + least(o.n, 5) + CASE WHEN regexp_matches(lower(name), '{'|'.join(algorithms.ENTRY_PARTS)}') THEN 2.0 ELSE 0.0 END)::DOUBLE, 9) AS score FROM gn JOIN o ON o.id = gn.id LEFT JOIN i ON i.id = gn.id ORDER BY score DESC, gn.id LIMIT 200",
)
add("execution_flows", lambda s, f: algorithms.processes(code_graph(s, f)))

# extraction and inventories

_LINES = "ln AS (SELECT file_path, generate_subscripts(t, 1)::BIGINT AS line, unnest(t) AS text FROM (SELECT file_path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS t FROM source_files))"
add(
    "todo_markers", lambda s, f: etl.todos(table(s, f, "source_files")),
    f"WITH {_LINES}, m AS (SELECT file_path, line, regexp_extract(text, '^\\s*(?://|/\\*|#|--|<!--|;|\\*+)\\s*(TODO|FIXME|HACK|XXX)(?:$|([^\\pL\\pN_].*)$)', ['kind', 'rest']) AS x FROM ln) SELECT file_path, line, x.kind AS kind, rtrim(left(regexp_replace(x.rest, '^[:(\\s]+', ''), 500)) AS text FROM m WHERE x.kind <> ''",
)
add(
    "folder_structure", lambda s, f: etl.structure(table(s, f, "source_files").select(F.col("file_path").alias("path")))[0],
    "WITH p AS (SELECT DISTINCT string_split(file_path, '/') AS p FROM source_files), u AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p), q AS (SELECT DISTINCT i = len(p) AS leaf, p[i] AS name, array_to_string(p[1:i], '/') AS file_path FROM u) SELECT CASE WHEN leaf THEN 'File' ELSE 'Folder' END || ':' || file_path AS id, CASE WHEN leaf THEN 'File' ELSE 'Folder' END AS label, name, file_path FROM q",
)
add(
    "folder_edges", lambda s, f: etl.structure(table(s, f, "source_files").select(F.col("file_path").alias("path")))[1].select("source_id", "target_id"),
    "WITH p AS (SELECT DISTINCT string_split(file_path, '/') AS p FROM source_files), u AS (SELECT p, unnest(range(2, len(p) + 1)) AS i FROM p) SELECT DISTINCT 'Folder:' || array_to_string(p[1:i - 1], '/') AS source_id, CASE WHEN i = len(p) THEN 'File' ELSE 'Folder' END || ':' || array_to_string(p[1:i], '/') AS target_id FROM u",
)
add("manifest", lambda s, f: etl.manifest(table(s, f, "source_files")), "SELECT file_path AS path, sha256(content) AS hash, strlen(content)::BIGINT AS size FROM source_files")
_CUT = "2025-07-01"
add(
    "manifest_diff", lambda s, f: etl.manifest_diff(etl.manifest(t.where(F.col("modified_at") < F.to_timestamp(F.lit(_CUT)))).groupBy("path").agg(F.min("hash").alias("hash")), etl.manifest(t).groupBy("path").agg(F.max("hash").alias("hash"))) if (t := table(s, f, "source_files")) else None,
    f"WITH a AS (SELECT file_path AS path, min(sha256(content)) AS h FROM source_files WHERE modified_at < TIMESTAMPTZ '{_CUT} 00:00:00+00' GROUP BY 1), b AS (SELECT file_path AS path, max(sha256(content)) AS h FROM source_files GROUP BY 1) SELECT b.path, CASE WHEN a.h IS NULL THEN 'added' ELSE 'modified' END AS change FROM b LEFT JOIN a USING (path) WHERE a.h IS DISTINCT FROM b.h",
)
add("extract_symbols", lambda s, f: etl.extract(etl.scan(table(s, f, "source_files").select(F.col("file_path").alias("path"), "content"))))
add("chunk_documents", lambda s, f: etl.chunks(table(s, f, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.col("text").alias("content"))))
add(
    "symbol_mentions", lambda s, f: etl.mentions(table(s, f, "documents").select(F.col("doc_id").cast("string").alias("source_path"), F.lit(0).alias("chunk_index"), F.col("text").alias("content")), code_graph(s, f).nodes),
    f"WITH {NODES}, w AS (SELECT DISTINCT doc_id::VARCHAR AS source_path, unnest(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+')) AS name FROM documents) SELECT DISTINCT source_path, 0 AS chunk_index, gn.id FROM w JOIN gn ON gn.name = w.name WHERE label IN ('Class', 'Method', 'Function', 'Interface', 'Struct', 'Controller', 'Service') AND length(gn.name) >= 5",
)
add(
    "lint_documents", lambda s, f: etl.lint(table(s, f, "documents").select(F.concat_ws("/", F.coalesce("repo", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.coalesce("title", F.lit("")), F.lit(".md"))).alias("source_path"), F.col("text").alias("content"))),
    r"""WITH p AS (SELECT coalesce(repo, 'none') || '/' || doc_id || '-' || coalesce(title, '') || '.md' AS source_path, coalesce(repo, 'none') || '/' AS folder, lower(doc_id || '-' || coalesce(title, '')) AS title, text AS content, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS t FROM documents),
l AS (SELECT source_path, folder, generate_subscripts(t, 1)::BIGINT AS line, unnest(t) AS text FROM p),
h AS (SELECT *, length(regexp_extract(text, '^\s*(#+) ', 1)) AS level, sum(CASE WHEN starts_with(ltrim(text), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY source_path ORDER BY line) AS fences FROM l),
e AS (SELECT source_path, content FROM p WHERE regexp_matches(title, 'service|controller') AND NOT contains(lower(content), '§4') AND NOT contains(lower(content), 'section 4') AND NOT contains(lower(content), 'algorithm'))
SELECT source_path, 'RED' AS severity, 'residual_todo' AS kind, line FROM l WHERE regexp_matches(text, 'TODO|TBD|FIXME|XXX') AND NOT regexp_matches(text, '^\s*```')
UNION ALL SELECT source_path, 'RED', 'unfilled_anchor', line FROM l WHERE regexp_matches(text, '<!-- [A-Z]+:.*-->')
UNION ALL SELECT source_path, 'YELLOW', 'missing_section', NULL FROM e
UNION ALL SELECT a.source_path, 'YELLOW', 'short_section', a.line FROM h a WHERE a.level IN (1, 2) AND regexp_matches(a.text, '[^# \t]')
  AND (SELECT coalesce(sum(CASE WHEN starts_with(ltrim(b.text), '```') OR starts_with(ltrim(b.text), '|') THEN 0 ELSE len(list_filter(regexp_split_to_array(b.text, '\s+'), lambda w: w <> '')) END), 0) FROM h b WHERE b.source_path = a.source_path AND b.line > a.line
       AND b.line < (SELECT coalesce(min(c.line), 1099511627776) FROM h c WHERE c.source_path = a.source_path AND c.line > a.line AND c.level > 0 AND c.level <= a.level AND (c.fences - a.fences) % 2 = 0)) < 50
  AND NOT EXISTS (SELECT 1 FROM h x WHERE x.source_path = a.source_path AND x.level = 1 AND a.level = 2 AND x.line < a.line)""".replace("\\\\", "\\"),
)
add(
    "log_counts", lambda s, f: etl.log_counts(etl.lines(table(s, f, "documents").select(F.col("doc_id").alias("file_path"), F.col("text").alias("content"))).select("text")),
    "WITH l AS (SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS text FROM documents), m AS (SELECT list_transform(list_filter(regexp_split_to_array(text, '[\\s|:]'), lambda w: regexp_matches(w, '^[A-Z]\\w*(?:Service|Controller|Repository|Manager|Helper|Provider|Factory|Client|Handler|Processor)\\.\\w')), lambda w: regexp_extract(w, '^\\w+\\.\\w+', 0)) AS a, list_filter(list_transform(regexp_split_to_array(text, '[\\s|(]')[:-2], lambda w: regexp_extract(w, '[A-Z]\\w{2,}\\.[A-Z]\\w+$', 0)), lambda w: w <> '') AS b FROM l) SELECT method, count(*) AS n FROM (SELECT unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS method FROM m) GROUP BY 1",
)


def _resolved(s: SparkSession, f: str) -> DataFrame:
    """Calls of the graph resolved anew: the arity is that of the method called, a named import the least exported symbol
    of an imported file, a package the folder of one."""
    g = code_graph(s, f)
    n = materialize(g.nodes.where(F.col("label").isin("Method", "Function")).select("id", "file_path", "name", "is_exported", "parameter_count"))
    # the least answer of a call id counts, so duplicates of edges need not go before the joins
    e = table(s, f, "edges").where("source_id is not null and target_id is not null")
    ends = e.where("rel_type = 'CALLS'").select("id", "source_id", "target_id").repartition("source_id").distinct()
    ends = ends.join(n.select(F.col("id").alias("source_id"), F.col("file_path").alias("file")), "source_id").join(n.select(F.col("id").alias("target_id"), "name", "parameter_count"), "target_id")
    calls = ends.select(F.col("id").alias("call_id"), "file", "name", F.col("parameter_count").alias("n_args"))
    symbols = n.select("id", F.col("file_path").alias("file"), "name", F.coalesce("is_exported", F.lit(False)).alias("is_exported"), F.lit(0).alias("required"), F.col("parameter_count").alias("params"))
    paths = g.label("File").select(F.col("id"), "file_path")
    imports = e.where("rel_type = 'IMPORTS'").select("source_id", "target_id").distinct().join(paths.select(F.col("id").alias("source_id"), F.col("file_path").alias("file")), "source_id").join(paths.select(F.col("id").alias("target_id"), F.col("file_path").alias("imported")), "target_id").select("file", "imported").distinct()
    least = symbols.where("is_exported").groupBy(F.col("file").alias("imported")).agg(F.min("name").alias("name"))
    named = imports.join(least, "imported").select("file", "name", F.col("imported").alias("source_file"), F.col("name").alias("source_name"))
    packages = imports.select("file", F.regexp_replace("imported", "/[^/]*$", "").alias("package")).distinct()
    return etl.resolve(calls, symbols, named, imports, packages)


add(
    "resolve_calls", _resolved,
    f"""{GRAPH}, n AS (SELECT id, file_path AS file, name, coalesce(is_exported, false) AS exported, parameter_count AS params FROM gn WHERE label IN ('Method', 'Function')), c AS (SELECT e.id AS call_id, s.file, t.name, t.params AS args FROM ge e JOIN n s ON s.id = source_id JOIN n t ON t.id = target_id WHERE type = 'CALLS'),
i AS (SELECT DISTINCT a.file_path AS file, b.file_path AS imported FROM ge JOIN gn a ON a.id = source_id AND a.label = 'File' JOIN gn b ON b.id = target_id AND b.label = 'File' WHERE type = 'IMPORTS'),
l AS (SELECT file, min(name) AS name FROM n WHERE exported GROUP BY 1), p AS (SELECT DISTINCT file, regexp_replace(imported, '/[^/]*$', '') AS package FROM i),
u AS (SELECT call_id, args, 2 AS k, n.* FROM c JOIN n ON n.file = c.file AND n.name = c.name UNION ALL SELECT call_id, args, 3, n.* FROM c JOIN i ON i.file = c.file JOIN l ON l.file = i.imported AND l.name = c.name JOIN n ON n.file = l.file AND n.name = l.name
      UNION ALL SELECT call_id, args, 4, n.* FROM c JOIN i ON i.file = c.file JOIN n ON n.file = i.imported AND n.name = c.name AND n.exported
      UNION ALL SELECT call_id, args, 5, n.* FROM c JOIN p ON p.file = c.file JOIN n ON n.name = c.name AND n.exported AND (n.file = package OR starts_with(n.file, package || '/') OR contains(n.file, '/' || package || '/'))
      UNION ALL SELECT call_id, args, 6, n.* FROM c JOIN n ON n.name = c.name AND n.exported),
b AS (SELECT call_id, min((k, CASE WHEN args IS NULL OR args BETWEEN 0 AND coalesce(params, 1073741824) THEN 0 ELSE 1 END, id)) AS b FROM u GROUP BY 1)
SELECT call_id, b[3] AS target_id, CASE b[1] WHEN 2 THEN 'same_file' WHEN 3 THEN 'named_import' WHEN 4 THEN 'import_scoped' WHEN 5 THEN 'package_scoped' ELSE 'global' END AS tier, CASE b[1] WHEN 2 THEN 1.0 WHEN 3 THEN 0.95 WHEN 4 THEN 0.8 WHEN 5 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM b""",
)

# views

add("path_prefix", lambda s, f: views.under(code_graph(s, f).nodes, "src/billing").select("id"), f"WITH {NODES} SELECT id FROM gn WHERE file_path = 'src/billing' OR starts_with(file_path, 'src/billing/')")
add("glob_files", lambda s, f: views.glob_files(code_graph(s, f), "src/**/*.py").select("file_path"), f"WITH {NODES} SELECT file_path FROM gn WHERE label = 'File' AND regexp_matches(file_path, '^src/(?:.*/)?[^/]*\\.py$')")
add("find_names", lambda s, f: views.find_names(code_graph(s, f).nodes, "^(load|save)[A-Z]"), f"WITH {NODES} SELECT id, label, name, file_path FROM gn WHERE regexp_matches(name, '^(load|save)[A-Z]') ORDER BY name, id LIMIT 50")
add("marker_probes", lambda s, f: views.marker_probes(code_graph(s, f).nodes, {"has_ledger": "ledger", "has_unicorn": "unicorn"}), f"WITH {NODES} SELECT coalesce(bool_or(contains(lower(name), 'ledger')), false) AS has_ledger, coalesce(bool_or(contains(lower(name), 'unicorn')), false) AS has_unicorn FROM gn")


def _versions(s: SparkSession, f: str) -> DataFrame:
    """Versions of nodes as changes of their files: an indexing run is a commit, lines are what it brings."""
    n = table(s, f, "nodes").where("file_path is not null and indexed_at is not null").distinct()
    lines = F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    return n.select(F.col("indexed_at").alias("commit"), F.col("indexed_at").alias("ts"), F.col("repo").alias("author"), F.col("file_path").alias("file"), lines.alias("added"), F.col("is_deleted").cast("long").alias("removed"))


add(
    "enrichment_priority", lambda s, f: analytics.enrichment_priority(code_graph(s, f), analytics.hotspots(_versions(s, f))).withColumn("priority", F.round("priority", 9)),
    f"""WITH {NODES}, {EDGES}, {_DEG}, v AS (SELECT DISTINCT * FROM nodes WHERE file_path IS NOT NULL AND indexed_at IS NOT NULL),
h AS (SELECT file_path, count(DISTINCT indexed_at) AS n_commits, sum(coalesce(end_line - start_line + 1, 0)) + sum(is_deleted::BIGINT) AS churn FROM v GROUP BY 1), hs AS (SELECT file_path, (n_commits * churn)::DOUBLE / max(n_commits * churn) OVER () AS hot FROM h),
q AS (SELECT gn.id, (0.35 * coalesce(hot, 0) + 0.25 * least((coalesce(n_in, 0) + coalesce(n_out, 0)) / 20.0, 1.0) + 0.2 * least(coalesce(end_line - start_line + 1, 0) / 500.0, 1.0) + CASE WHEN coalesce(is_traced, false) THEN 0 ELSE 0.1 END + CASE WHEN coalesce(is_dead_candidate, false) THEN 0.1 ELSE 0 END)::DOUBLE AS p FROM gn LEFT JOIN d ON gn.id = d.id LEFT JOIN hs ON gn.file_path = hs.file_path) SELECT id, round(p, 9) AS priority FROM q WHERE p >= 0.05""",
)
add(
    "retrieve", lambda s, f: views.retrieve(code_graph(s, f).nodes, "ledger mapper billing", 20).select("rank", "id", F.round("score", 6).alias("score")),
    f"WITH {NODES}, {_NODE_BM} SELECT row_number() OVER (ORDER BY round(score, 12) DESC, id) AS rank, id, round(score, 6) AS score FROM bm ORDER BY 1 LIMIT 20",
)
_IMPORT = r"""(?:from|require\(|import)\s*["']([^"']+)["']"""
add("source_imports", lambda s, f: views.resolve_imports(etl.lines(t := table(s, f, "source_files")).select(F.col("file_path").alias("file"), F.regexp_extract("text", _IMPORT, 1).alias("module")).where("module <> ''"), t.select(F.col("file_path").alias("path"))))


def _imported(s: SparkSession, f: str) -> DataFrame:
    """The import edges of files, their targets named by the last two parts of the path without its extension."""
    g = code_graph(s, f)
    paths = g.label("File").where("file_path is not null").select("id", "file_path")
    j = g.out_edges("IMPORTS").join(paths.select(F.col("id").alias("source_id"), F.col("file_path").alias("file")), "source_id").join(paths.select(F.col("id").alias("target_id"), "file_path"), "target_id")
    return views.resolve_imports(j.select("file", F.regexp_extract("file_path", r"([^/]+/[^/.]+)(?:\.[A-Za-z]+)+$", 1).alias("module")).where("module <> ''"), paths.select(F.col("file_path").alias("path")))


add(
    "resolve_imports", _imported,
    f"""{GRAPH}, p AS (SELECT DISTINCT id, file_path AS path, regexp_replace(file_path, '/(?:index\\.[jt]sx?|__init__\\.py|mod\\.rs)$|\\.[A-Za-z]+$', '', 'g') AS stem FROM gn WHERE label = 'File' AND file_path IS NOT NULL),
m AS (SELECT DISTINCT a.path AS file, regexp_extract(b.path, '([^/]+/[^/.]+)(?:\\.[A-Za-z]+)+$', 1) AS module FROM ge JOIN p a ON a.id = source_id JOIN p b ON b.id = target_id WHERE type = 'IMPORTS')
SELECT file, module, min((length(path), path))[2] AS target FROM m JOIN p ON (stem = replace(module, '.', '/') OR ends_with(stem, '/' || replace(module, '.', '/'))) AND path <> file WHERE module <> '' GROUP BY 1, 2""",
)

# interchange and streams

add("edge_csv_rows", lambda s, f: interchange.edge_rows(code_graph(s, f).edges), f"WITH {EDGES} SELECT source_id AS \"from\", target_id AS \"to\", type, printf('%.4f', coalesce(confidence, 1.0)) AS confidence, coalesce(reason, '') AS reason, step FROM ge")
add("node_csv_rows", lambda s, f: interchange.node_rows(code_graph(s, f).nodes), f"WITH {NODES} SELECT label, id, name, file_path AS filePath, '' AS content, start_line AS startLine, end_line AS endLine, language, is_exported AS isExported FROM gn")
_Q = "replace(replace({c}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
add(
    "dot_export", lambda s, f: interchange.dot_lines(code_graph(s, f)).select("value"),
    f"""WITH {NODES}, {EDGES} SELECT 'digraph G {{' AS value UNION ALL SELECT '}}' UNION ALL SELECT '  "' || {_Q.format(c='id')} || '" [label="' || label || ': ' || {_Q.format(c='name')} || '"];' FROM gn UNION ALL SELECT '  "' || {_Q.format(c='source_id')} || '" -> "' || {_Q.format(c='target_id')} || '" [label="' || type || '"];' FROM ge""",
)
add("registry_latest", lambda s, f: interchange.registry(table(s, f, "registry")).select("name", "indexed_at", "last_commit"), "SELECT name, indexed_at, last_commit FROM registry QUALIFY row_number() OVER (PARTITION BY name ORDER BY indexed_at DESC, path) = 1")


def _stream_counts(s: SparkSession, f: str) -> DataFrame:
    """The event table as a stream to its end; the result holds one row a day and type."""
    schema = table(s, f, "events").schema
    # a file stream reads folders, and a pattern may name the one table
    q = windowed_counts(s.readStream.schema(schema).parquet(f"{f}/events.parque[t]")).writeStream.outputMode("complete").format("memory").queryName("codeloom_daily").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table("codeloom_daily").select("start", "event_type", "n", F.round("total", 4).alias("total"))


add("stream_daily_counts", _stream_counts, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
add(
    "user_sessions", lambda s, f: sessions(table(s, f, "events")),
    "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, s",
)
