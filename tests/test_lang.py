import pytest

from codeloom.graph import PropertyGraph
from codeloom.lang.compile import backend_query, run_query
from codeloom.lang.syntax import Op, QueryError, escape, is_write, parse

NODE = "id string, label string, name string, file_path string, start_line long, end_line long, is_exported boolean, weight double"
EDGE = "id string, source_id string, target_id string, type string, confidence double, reason string, step int"


@pytest.fixture(scope="module")
def g(spark):
    n = [("f1", "Function", "handleLogin", "src/a.ts", 10, 30, True, 2.0), ("f2", "Function", "validateUser", "src/a.ts", 35, 50, False, 2.5), ("f3", "Function", "hash", "src/b.ts", 1, 5, True, None), ("c1", "Class", "User", "src/u.ts", None, None, None, None)]
    e = [("e1", "f1", "f2", "CALLS", 1.0, "", None), ("e2", "f2", "f3", "CALLS", 0.9, "", None), ("e3", "f1", "f2", "CALLS", 0.5, "again", None), ("e4", "f3", "gone", "CALLS", 1.0, "", None), ("e5", "f3", "f3", "USES", 1.0, "", None)]
    return PropertyGraph(spark.createDataFrame(n, NODE).cache(), spark.createDataFrame(e, EDGE).cache())


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scan_filter_order_limit(g):
    assert rows(run_query(g, "MATCH (f:Function) WHERE f.startLine > 5 RETURN f.name AS n, f.end_line ORDER BY n DESC LIMIT 1")) == [("validateUser", 50)]
    out = run_query(g, "MATCH (f:Function) RETURN f.name, f.start_line ORDER BY f.name LIMIT 2")
    assert out.columns == ["f.name", "f.start_line"] and rows(out) == [("handleLogin", 10), ("hash", 1)]


def test_alias_hides_order_key(g):
    out = rows(run_query(g, "MATCH (f:Function) RETURN f.name AS n ORDER BY f.name"))
    assert {x[0] for x in out} == {"handleLogin", "hash", "validateUser"}


def test_hop_is_a_set_in_cql_and_a_bag_in_cypher(g):
    q = "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a.name, b.name"
    assert sorted(rows(run_query(g, q))) == [("handleLogin", "validateUser"), ("validateUser", "hash")]
    assert len(rows(run_query(g, q, "cypher"))) == 3


def test_dangling_target(g):
    assert rows(run_query(g, "MATCH (a)-[:CALLS]->(b) WHERE a.name = 'hash' RETURN b.name")) == []
    assert rows(run_query(g, "MATCH (a)-[:CALLS]->(b) WHERE a.name = 'hash' RETURN b.name", "cypher")) == [(None,)]


def test_directions_and_self_loop(g):
    assert rows(run_query(g, "MATCH (a)<-[:CALLS]-(b) WHERE a.name = 'hash' RETURN b.name")) == [("validateUser",)]
    assert len(rows(run_query(g, "MATCH (a)-[:USES]-(b) RETURN a.id", "cypher"))) == 2
    assert len(rows(run_query(g, "MATCH (a)-[:USES]-(b) RETURN a.id"))) == 1


def test_chain_and_bound_variable(g):
    assert rows(run_query(g, "MATCH (a)-[:CALLS]->(b)-[:CALLS]->(c) RETURN a.name, c.name")) == [("handleLogin", "hash")]
    assert rows(run_query(g, "MATCH (a)-[:USES]->(a) RETURN a.name")) == [("hash",)]
    assert rows(run_query(g, "MATCH (a:Function)-[:CALLS]->(b), (b)-[:CALLS]->(c:Function) RETURN a.id, b.id, c.id")) == [("f1", "f2", "f3")]


def test_anonymous_source_leads_nowhere_unless_told(g):
    q = "MATCH (:Function)-[:CALLS]->(b:Function) RETURN b.name"
    assert rows(run_query(g, q)) == []
    assert {x[0] for x in rows(run_query(g, q, compat=False))} == {"validateUser", "hash"}


def test_unknown_label_and_type(g):
    assert rows(run_query(g, "MATCH (a:Nothing) RETURN a.id")) == []
    assert len(rows(run_query(g, "MATCH (a)-[:NOPE]->(b) RETURN a.id, b.id"))) == 3
    with pytest.raises(QueryError):
        run_query(g, "MATCH (a)-[:NOPE]->(b) RETURN a.id", compat=False)


def test_variable_length(g):
    q = "MATCH (a)-[:CALLS*1..2]->(b:Function) WHERE a.name = 'handleLogin' RETURN b.name"
    assert rows(run_query(g, q)) == [("validateUser",)]
    assert {x[0] for x in rows(run_query(g, q, varlen=True))} == {"validateUser", "hash"}


def test_inline_properties_are_strict(g):
    assert rows(run_query(g, "MATCH (a {name: 'hash'}) RETURN a.id")) == [("f3",)]
    assert rows(run_query(g, "MATCH (a {weight: 2}) RETURN a.id")) == []
    assert rows(run_query(g, "MATCH (a {weight: 2.0}) RETURN a.id")) == [("f1",)]
    assert rows(run_query(g, "MATCH (a {start_line: null}) RETURN a.id")) == [("c1",)]


@pytest.mark.parametrize(
    "where,ids",
    [
        ("n.weight = 2", ["f1"]), ("n.weight <> 2", ["c1", "f2", "f3"]), ("n.weight = null", ["c1", "f3"]), ("NOT n.is_exported", ["f2"]), ("n.name", ["c1", "f1", "f2", "f3"]), ("n.nothing", []), ("n.name IN ['hash', 'User']", ["c1", "f3"]),
        ("n.name =~ 'log|Log'", ["f1"]), ("n.name STARTS WITH 'h' AND n.name ENDS WITH 'n'", ["f1"]), ("n.name CONTAINS 5", []), ("n.start_line >= 10 OR n.label = 'Class'", ["c1", "f1", "f2"]), ("n.name < 5", []), ("x.name = 'hash'", []),
        ("n.start_line + 1 = 2", ["f3"]), ("NOT n.name", []), ("(n.is_exported OR n.weight = 2.5) AND n.start_line < 20", ["f1", "f3"]),
    ],
)
def test_predicates(g, where, ids):
    assert sorted(x[0] for x in rows(run_query(g, f"MATCH (n) WHERE {where} RETURN n.id"))) == ids


def test_unbound_in_return_fails(g):
    with pytest.raises(QueryError):
        run_query(g, "MATCH (n) RETURN m.name")


def test_aggregates(g):
    out = run_query(g, "MATCH (n) RETURN count(n.weight) AS n, sum(n.weight) AS s, avg(n.weight) AS a, min(n.weight) AS lo, max(n.weight) AS hi, count(DISTINCT n.weight) AS d, sum(n.name) AS z")
    assert rows(out) == [(4, 4.5, 1.125, 2.0, 2.5, 3, 0.0)]
    assert rows(run_query(g, "MATCH (n:None) RETURN count(*), sum(n.weight), avg(n.weight)")) == [(0, 0.0, None)]
    assert rows(run_query(g, "MATCH (n) RETURN n.label AS l, count(*) AS k")) == [(None, 4)]
    assert sorted(rows(run_query(g, "MATCH (n) RETURN n.label AS l, count(*) AS k", implicit_grouping=True))) == [("Class", 1), ("Function", 3)]
    got = rows(run_query(g, "MATCH (n) RETURN collect(n.weight) AS c"))[0][0]
    assert len(got) == 4 and got.count(None) == 2


def test_functions(g):
    out = rows(run_query(g, "MATCH (n {id: 'c1'}) RETURN toUpper(n.name), size(n.name), toString(n.weight), coalesce(n.weight, 1.5), toString(n)"))
    assert out == [("USER", 4, "null", 1.5, "(c1)")]
    assert rows(run_query(g, "MATCH (n {id: 'f1'}) RETURN toString(n.weight) AS t, toLower(n.name) AS l, n.start_line - 3 AS m, n.name + '!' AS x")) == [("2", "handlelogin", 7, "handleLogin!")]
    with pytest.raises(QueryError):
        run_query(g, "MATCH (n) RETURN sqrt(n.weight)")


def test_overflow(spark):
    g = PropertyGraph(spark.createDataFrame([("a", "F", "a", "a", (1 << 63) - 1)], "id string, label string, name string, file_path string, n long"), spark.createDataFrame([], EDGE))
    assert rows(run_query(g, "MATCH (a) RETURN a.n + 1 AS x")) == [(None,)]
    assert rows(run_query(g, "MATCH (a) RETURN a.n + 1 AS x", promote_overflow=True))[0][0] == float(1 << 63)


def test_cypher_dialect(g):
    assert rows(run_query(g, "MATCH (n:Function) WHERE n.startLine = 10 OR NOT n.name CONTAINS 'h' RETURN n.id ORDER BY n.id", "cypher")) == [("f1",), ("f2",)]
    assert rows(run_query(g, "MATCH (n) WHERE n.weight = '2' RETURN n._id", "cypher")) == [("f1",)]
    assert rows(run_query(g, "MATCH (n) WHERE n.weight <> '2' RETURN n.id", "cypher")) == [("f2",)]
    assert rows(run_query(g, "MATCH (n:Function) RETURN count(n) LIMIT 1", "cypher")) == [(3,)]
    assert rows(run_query(g, "MATCH (n) RETURN DISTINCT n.label ORDER BY n.label", "cypher")) == [("Class",), ("Function",)]
    assert [x[0] for x in rows(run_query(g, "MATCH (n) RETURN n.id ORDER BY n.startLine", "cypher"))] == ["f3", "f1", "f2", "c1"]
    assert '"_label":"Class"' in rows(run_query(g, "MATCH (n:Class) RETURN n", "cypher"))[0][0]
    assert len(rows(backend_query(g, "MATCH (n) RETURN n.id", cap=2))) == 2


@pytest.mark.parametrize("text,dialect", [("MATCH (n RETURN n", "cql"), ("MATCH (n) RETURN n extra", "cql"), ("MATCH () RETURN 1", "cypher"), ("MATCH (a)-[:X]->(b)-[:Y]->(c) RETURN a", "cypher"), ("MATCH (n) WHERE n.x < 3 RETURN n", "cypher"), ("CREATE (n) RETURN n", "cql"), ("MATCH (n) DELETE n", "cypher"), ("", "cql"), ("CALL NOPE('a', 'b')", "other")])
def test_refused(text, dialect):
    with pytest.raises(QueryError):
        parse(text, dialect)


def test_precedence_and_helpers():
    w = parse("MATCH (n) WHERE n.a = 1 OR n.b = 2 AND NOT n.c = 3 RETURN n").where
    assert w.op == "or" and w.right.op == "and" and w.right.right == Op("not", Op("=", w.right.right.left.left, w.right.right.left.right))
    assert not is_write("MATCH (n) WHERE n.name = 'SET' RETURN n // DELETE") and is_write("match (n) set n.x = 1")
    assert escape("it's\\\n\0") == "it\\'s\\\\\\n"
    assert parse("MATCH (n) WHERE n.name = 'it\\'s' RETURN n", "cypher").where.right.value == "it's"


def test_call(g):
    assert {x[0] for x in rows(run_query(g, "CALL QUERY_FTS_INDEX('x', 'USER')").select("name"))} == {"validateUser", "User"}
    assert rows(run_query(g, "CALL QUERY_FTS_INDEX('fts_Function', 'hash')", "cypher").select("name")) == [("hash",)]
    with pytest.raises(QueryError):
        run_query(g, "CALL OTHER('x', 'y')")


def test_pushdown(g, spark, tmp_path):
    g.nodes.write.parquet(str(tmp_path / "n"))
    p = PropertyGraph(spark.read.parquet(str(tmp_path / "n")), g.edges)
    plan = run_query(p, "MATCH (n:Function) WHERE n.name = 'hash' RETURN n.id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualNullSafe(name,hash)" in plan and "start_line" not in plan


def test_graph_changes(g, spark):
    n = spark.createDataFrame([("f1", "Function", "renamed", "src/a.ts", 1, 2, True, None)], NODE)
    u = g.upsert_nodes(n)
    assert u.nodes.count() == 4 and u.node("f1").first()["name"] == "renamed"
    r = g.remove_nodes(spark.createDataFrame([("f2",)], "id string"))
    assert r.nodes.count() == 3 and {x.id for x in r.edges.collect()} == {"e4", "e5"}
    assert g.remove_label("Class").nodes.count() == 3 and g.remove_files(spark.createDataFrame([("src/a.ts",)], "file_path string")).nodes.count() == 2
