"""Queries of the general data problems: hierarchies (p2) and references without a record (p3), with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.components import strongly_connected
from codeloom.operators.hierarchy import descendant_counts, descendants, loop_descendants, resolve_hierarchy
from codeloom.operators.orphans import edge_references, find_orphans, node_versions
from codeloom.session import materialize, month_label, table

#: Kinds of heritage that name no parent class.
NOT_PARENTS = ("implements", "heritage.implements", "trait", "heritage.trait", "uses")
SEP = "\u0001"


def simple_name(name: Column) -> Column:
    """A class name without outer blanks, type arguments and namespace; null if nothing is left."""
    for _ in range(4):
        name = F.regexp_replace(name, r"<[^<>]*>|\[[^\[\]]*\]", "")
    name = F.regexp_replace(name, r"[<\[].*$", "")
    name = F.regexp_replace(name, r"^\s+|\s+$", "")
    name = F.regexp_extract(name, r"([^.:\\/]*)$", 1)
    name = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.when(name != "", name)


def class_links(heritage: DataFrame) -> DataFrame:
    """(node, parent) links of classes; the keys hold the repository and the simple name."""
    rows = heritage.select(
        F.coalesce("repo", F.lit("")).alias("repo"), simple_name(F.col("class_name")).alias("name"), F.when(~F.coalesce(F.col("kind").isin(*NOT_PARENTS), F.lit(False)), simple_name(F.col("parent_name"))).alias("up")
    ).where("name is not null")
    return rows.select(F.concat_ws(SEP, "repo", "name").alias("node"), F.when(F.col("up").isNotNull(), F.concat_ws(SEP, "repo", "up")).alias("parent"))


def file_links(circular: DataFrame) -> DataFrame:
    """(src, dst) links between consecutive entries of the reported lists; null entries break the list."""
    c = circular.where(F.size("cycle") > 1).select(F.coalesce("repo", F.lit("")).alias("repo"), F.expr("slice(cycle, 1, size(cycle) - 1)").alias("a"), F.expr("slice(cycle, 2, size(cycle) - 1)").alias("b"))
    p = c.distinct().select("repo", F.explode(F.arrays_zip("a", "b")).alias("p")).where("p.a is not null and p.b is not null")
    return p.select(F.concat_ws(SEP, "repo", "p.a").alias("src"), F.concat_ws(SEP, "repo", "p.b").alias("dst"))


def _repo(key: Column) -> Column:
    return F.substring_index(key, SEP, 1)


def _name(key: Column) -> Column:
    return F.substring_index(key, SEP, -1)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every class; classes and files caught in a loop have depth -1."""
    r = resolve_hierarchy(class_links(table(spark, sf, "heritage")))
    classes = r.select(F.lit("class").alias("scope"), _repo(F.col("node")).alias("repo"), _name(F.col("node")).alias("member"), F.coalesce(_name(F.col("root")), F.lit("")).alias("root_name"), "depth")
    s = strongly_connected(file_links(table(spark, sf, "circular_dependencies")))
    files = s.select(F.lit("file").alias("scope"), _repo(F.col("node")).alias("repo"), _name(F.col("node")).alias("member"), F.lit("").alias("root_name"), F.lit(-1).alias("depth"))
    return classes.unionByName(files)


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every class with its full path, depth, root, number of descendants and height of its family."""
    r = resolve_hierarchy(class_links(table(spark, sf, "heritage")), with_paths=True)
    d = descendant_counts(r)
    return r.join(d, "node", "left").select(
        _repo(F.col("node")).alias("repo"),
        _name(F.col("node")).alias("member"),
        F.array_join(F.transform("path", lambda x: F.substring_index(x, SEP, -1)), " > ").alias("path"),
        F.col("depth").cast("int").alias("depth"),
        F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"),
        F.coalesce("height", F.lit(0)).cast("int").alias("height"),
    )


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every class with each of its descendants and the distance, also on loops and below them."""
    links = materialize(class_links(table(spark, sf, "heritage")))
    r = resolve_hierarchy(links, with_paths=True)
    d = descendants(r).unionByName(loop_descendants(links, r))
    return d.select(_repo(F.col("ancestor")).alias("repo"), _name(F.col("ancestor")).alias("ancestor"), _name(F.col("descendant")).alias("descendant"), "distance")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Edge ends whose node is not live when the edge is recorded."""
    o = find_orphans(edge_references(table(spark, sf, "edges")), node_versions(table(spark, sf, "nodes")))
    return o.select(F.col("ref").alias("id"), "endpoint").distinct()


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, end and month."""
    o = find_orphans(edge_references(table(spark, sf, "edges")), node_versions(table(spark, sf, "nodes")))
    return o.groupBy(F.lit("edges").alias("table_name"), "endpoint", month_label(F.col("period")).alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_keys"))


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_report": p3_report}


def _simple_sql(c: str) -> str:
    x = c
    for _ in range(4):
        x = f"regexp_replace({x}, '<[^<>]*>|\\[[^\\[\\]]*\\]', '', 'g')"
    x = f"regexp_replace({x}, '[<\\[].*$', '')"
    x = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    x = f"regexp_extract({x}, '([^.:\\\\/]*)$', 1)"
    return f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


_KINDS = ", ".join(f"'{k}'" for k in NOT_PARENTS)
_CLASSES = f"""
rows_ AS (SELECT coalesce(repo, '') AS repo, {_simple_sql('class_name')} AS name,
                 CASE WHEN kind IS NULL OR kind NOT IN ({_KINDS}) THEN {_simple_sql('parent_name')} END AS up FROM heritage),
link AS (SELECT repo, name, min(up) AS up FROM rows_ WHERE name IS NOT NULL GROUP BY repo, name),
walk(repo, name, cur, path, depth, state) AS (
  SELECT repo, name, name, [name], 0, 'go' FROM link
  UNION ALL
  SELECT w.repo, w.name, coalesce(l.up, w.cur), CASE WHEN l.up IS NULL THEN w.path ELSE list_append(w.path, l.up) END,
         w.depth + CASE WHEN l.up IS NULL THEN 0 ELSE 1 END,
         CASE WHEN l.up IS NULL THEN 'end' WHEN list_contains(w.path, l.up) THEN 'loop' ELSE 'go' END
  FROM walk w LEFT JOIN link l ON w.repo = l.repo AND w.cur = l.name WHERE w.state = 'go')"""
_ORPHANS = """
ref AS (SELECT DISTINCT id, 'source' AS endpoint, source_id AS key, recorded_at FROM edges WHERE source_id IS NOT NULL
        UNION SELECT DISTINCT id, 'target', target_id, recorded_at FROM edges WHERE target_id IS NOT NULL),
ver AS (SELECT id AS key, indexed_at, bool_or(NOT coalesce(is_deleted, false)) AS live FROM nodes WHERE id IS NOT NULL AND indexed_at IS NOT NULL GROUP BY ALL),
orphan AS (SELECT r.id, r.endpoint, r.key, r.recorded_at FROM ref r LEFT JOIN ver v ON r.key = v.key AND v.indexed_at <= r.recorded_at
           GROUP BY r.id, r.endpoint, r.key, r.recorded_at HAVING NOT coalesce(arg_max(v.live, v.indexed_at), false))"""

ORACLE = {
    "p2_found": f"""WITH RECURSIVE {_CLASSES},
fe AS (SELECT DISTINCT coalesce(repo, '') AS repo, cycle[i] AS a, cycle[i + 1] AS b FROM circular_dependencies, range(1, len(cycle)) t(i) WHERE cycle[i] IS NOT NULL AND cycle[i + 1] IS NOT NULL),
fr(repo, a, b) AS (SELECT repo, a, b FROM fe UNION SELECT r.repo, r.a, e.b FROM fr r JOIN fe e ON r.repo = e.repo AND r.b = e.a)
SELECT 'class' AS scope, repo, name AS member, CASE state WHEN 'end' THEN cur ELSE '' END AS root_name, CASE state WHEN 'end' THEN depth ELSE -1 END::INT AS depth FROM walk WHERE state <> 'go'
UNION ALL SELECT DISTINCT 'file', repo, a, '', -1 FROM fr WHERE a = b""",
    "p2_paths": f"""WITH RECURSIVE {_CLASSES},
ok AS (SELECT repo, name, list_reverse(path) AS path, depth FROM walk WHERE state = 'end'),
an AS (SELECT repo, path[len(path) - d] AS name, d FROM ok, range(1, len(path)) t(d)),
dc AS (SELECT repo, name, count(*) AS n, max(d) AS h FROM an GROUP BY repo, name)
SELECT w.repo, w.name AS member, CASE w.state WHEN 'end' THEN array_to_string(list_reverse(w.path), ' > ') END AS path, CASE w.state WHEN 'end' THEN w.depth ELSE -1 END::INT AS depth,
       coalesce(dc.n, 0)::BIGINT AS n_descendants, coalesce(dc.h, 0)::INT AS height
FROM walk w LEFT JOIN dc ON w.repo = dc.repo AND w.name = dc.name WHERE w.state <> 'go'""",
    "p2_descendants": f"""WITH RECURSIVE {_CLASSES},
an AS (SELECT repo, path[d + 1] AS ancestor, name AS descendant, d FROM walk, range(1, len(path)) t(d) WHERE state <> 'go')
SELECT repo, ancestor, descendant, min(d)::INT AS distance FROM an WHERE ancestor <> descendant GROUP BY ALL""",
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT id, endpoint FROM orphan",
    "p3_report": f"WITH {_ORPHANS} SELECT 'edges' AS table_name, endpoint, strftime(recorded_at, '%Y-%m') AS month, count(DISTINCT (id, key)) AS n_orphans, count(DISTINCT key) AS n_keys FROM orphan GROUP BY 1, 2, 3",
}
