import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import kernels as K
from codeloom.graph import PropertyGraph
from codeloom.operators import algorithms as A
from codeloom.operators import analytics as N
from codeloom.operators import search as S
from codeloom.operators import traverse as T

NODE = "id string, label string, name string, file_path string, start_line long, end_line long, is_exported boolean, is_traced boolean, is_dead_candidate boolean, complexity long, language string, repo string"
EDGE = "id string, source_id string, target_id string, type string, confidence double, reason string, step int"


def graph(spark, nodes, edges):
    full = [(i, label, name, path, *(rest + (None,) * 8)[:8]) for i, label, name, path, *r in nodes for rest in (tuple(r),)]
    e = [(f"e{k}", a, b, t, 1.0, None, s[0] if s else None) for k, (a, b, t, *s) in enumerate(edges)]
    return PropertyGraph(spark.createDataFrame(full, NODE), spark.createDataFrame(e, EDGE))


@pytest.fixture(scope="module")
def g(spark):
    n = [("a", "Method", "alpha", "src/x/a.cs", 1, 10, True, True, None, 3), ("b", "Method", "beta", "src/x/a.cs", 11, 20, None, None, True, 7), ("c", "Function", "gamma", "src/service/c.ts", 1, 5, None, None, None, 12), ("d", "Method", "delta", "src/repository/d.cs", None, None, None, None, None, 25), ("K", "Class", "Kappa", "src/controllers/k.cs"), ("P", "Process", "flow", "p"), ("C", "Community", "team Blue", "c")]
    e = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "d", "CALLS"), ("c", "a", "USES"), ("K", "a", "HAS_METHOD"), ("K", "b", "HAS_METHOD"), ("a", "P", "STEP_IN_PROCESS", 2), ("b", "P", "STEP_IN_PROCESS", 1), ("a", "C", "MEMBER_OF"), ("K", "d", "CALLS"), ("d", "nowhere", "CALLS")]
    return graph(spark, n, e)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_kernels(spark):
    d = spark.createDataFrame([("Été, naïve-42 x_y", "a/PACKAGES/b.js", "src/app/(g)/u/[id]/route.ts", "/x/", [1.0, 0.0], [1.0, 1.0])], "t string, p string, n string, r string, a array<double>, b array<double>")
    r = d.select(K.tokens(F.col("t")), K.path_weight(F.col("p")), K.next_route(F.col("n")), K.normalize_route(F.col("r")), K.cosine(F.col("a"), F.col("b")), K.cosine(F.col("a"), F.array(F.lit(1.0))), K.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), K.normalize_route(F.lit("x")), K.normalize_route(F.lit("/"))).first()
    assert r[0] == ["été", "naïve", "42", "x", "y"] and r[1] == 0.1 and r[2] == "/u/:id" and r[3] == "/x" and abs(r[4] - 0.5**0.5) < 1e-12 and r[5] == 0 and abs(r[6] - 1 / 3) < 1e-12 and r[7] == "/x" and r[8] == "/"
    m = spark.createDataFrame([("src/auth/x.ts",), ("src/x.ts",), ("x.ts",)], "p string").select(K.module_of(F.col("p")))
    assert [x[0] for x in m.collect()] == ["src/auth", "src", "x.ts"]
    assert d.select(K.mermaid_escape(F.lit("a<b>&(c)"))).first()[0] == "a&lt;b&gt;&amp;&#40;c&#41;"


def test_bm25_formula(spark):
    docs = [(1, "red blue"), (2, "red red green"), (3, "green"), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "id int, text string")
    res = {x.id: x.score for x in S.bm25(d, "id", F.col("text"), "Red, red!").collect()}
    n, df, avg = 5, 2, 6 / 5
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    f = lambda tf, length: 2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert res == pytest.approx({1: f(1, 2), 2: f(2, 3)})
    assert S.bm25(d, "id", F.col("text"), "nothing").count() == 0
    assert S.bm25(d.limit(0), "id", F.col("text"), "red").count() == 0


def test_search_nodes(g):
    r = S.bm25_nodes(g.nodes, "alpha", limit=5).collect()
    assert r[0]["id"] == "a" and r[0]["rank"] == 1
    assert [x["node_id"] for x in S.search_files(g.nodes, "alpha beta src", 10).where("file_path = 'src/x/a.cs'").collect()] in (["a"], ["b"])
    c = S.search_code(g.nodes, g.edges, "alpha", 3).where("id = 'a'").first()
    assert c["calls"] == ["b"] and c["called_by"] == ["c"]
    p = {(x["id"], x["process"]) for x in S.group_by_process(S.bm25_nodes(g.nodes, "alpha gamma", limit=9), g.nodes, g.edges).collect()}
    assert p == {("a", "flow"), ("c", None)}


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "node_id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "node_id string, rank int")
    r = S.fuse(("bm25", a), ("semantic", b)).collect()
    assert [x["node_id"] for x in r] == ["y", "x", "z"] and r[0]["score"] == pytest.approx(1 / 62 + 1 / 61) and r[1]["score"] == pytest.approx(1 / 61) and r[0]["sources"] == ["bm25", "semantic"]
    v = spark.createDataFrame([("f1", [1.0, 0.0]), ("f2", [0.0, 1.0]), ("f3", [1.0])], "node_id string, embedding array<double>")
    assert [x["node_id"] for x in S.semantic(v, "node_id", [1.0, 0.1], 2).collect()] == ["f1", "f2"]
    with pytest.raises(ValueError):
        S.semantic(v, "node_id", [0.0, 0.0])
    assert [x["node_id"] for x in S.rerank(S.fuse(("a", a)), lambda rows: [1, 7, 1]).orderBy("rank").collect()] == ["y", "x"]
    assert S.parse_ranking("2, 9, 1 and 2", 3) == [1, 0]


def test_semantic_batch_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], "x") for i in range(90)] + [(200, [0.0] * 4, "x"), (201, [1.0], "x"), (202, None, "x")]
    d = spark.createDataFrame(rows, "id int, embedding array<double>, score string")
    out = S.semantic_batch(d, d.where("id % 10 = 0"), "id", 5, block=25)

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 12) if na * nb else 0.0

    for q, v, _ in rows:
        if q % 10 == 0 and v:
            best = sorted(((-cos(v, w), i) for i, w, _ in rows if w and len(w) == len(v)))[:5]
            mine = sorted((-x["score"], x["id"]) for x in out.where(F.col("query_id") == q).collect())
            assert [i for _, i in mine] == [i for _, i in best]


def test_traversals(g, spark):
    assert got(T.impact(g, "delta").select("id", "depth")) == [("K", 1), ("a", 3), ("b", 2), ("c", 1)]
    assert got(T.impact(g, "ALPHA", "downstream", 2).select("id", "depth")) == [("b", 1), ("c", 2)]
    assert got(T.shortest_path(g, "a", "d")) == [(3, ["a", "b", "c", "d"])] and got(T.shortest_path(g, "a", "a")) == [(0, ["a"])]
    assert got(T.shortest_path(g, "d", "a")) == [] and got(T.shortest_path(g, "d", "a", directed=False))[0][0] == 2
    n, e = T.subgraph(g, "a", 1)
    assert [x[0] for x in got(n)] == ["C", "K", "P", "a", "b", "c"] and e.count() == 8
    assert T.subgraph(g, "a", 2, cap=2)[0].count() == 2
    assert ("src/controllers/k.cs", 1, 0) in got(T.trace_files(g, "Kappa"))
    assert ("in", "HAS_METHOD", "K", "Kappa") in got(T.context(g, "alpha"))
    s = T.symbol_context(g, "b").first()
    assert s["callers"] == ["a"] and s["callees"] == ["c"] and s["imports"] == []
    hunks = spark.createDataFrame([("src/x/a.cs", 12, 12), ("src/x/none.cs", 1, 9)], "file string, start long, end long")
    assert [x[0] for x in got(T.changed_symbols(g.nodes, hunks))] == ["b"]
    d = T.detect_changes(g, hunks).first()
    assert (d["n_changed"], d["n_direct"], d["n_processes"], d["risk"]) == (1, 1, 1, "medium")
    assert got(T.process_steps(g)) == [("P", 1, "b", "beta"), ("P", 2, "a", "alpha")]
    assert got(T.communities(g)) == [("C", "team Blue", 1)] and got(T.communities(g, "blue"))[0][1] == "a"
    assert 'A["alpha"]' in T.mermaid(g, "a").first()[0] and '"beta"' in T.mermaid(g, "a").first()[0]
    assert {x[1] for x in got(T.coverage_flow(g, "Kappa").select("id", "name"))} == {"alpha", "beta", "gamma", "delta"}


def test_rename_preview(g, spark):
    files = spark.createDataFrame([("src/x/a.cs", "def alpha\nx\n" + "\n" * 9 + "alpha()\nalphabet"), ("o.cs", "call alpha"), ("n.cs", None)], "file_path string, content string")
    assert got(T.rename_preview(g, files, "a", "alpha").select("file_path", "line", "confidence")) == [("o.cs", 1, 0.5), ("src/x/a.cs", 1, 1.0), ("src/x/a.cs", 12, 0.5)]


def test_analytics(g):
    r = N.complexity_report(g.nodes).first()
    assert (r["n"], r["max_complexity"], r["p50"], r["n_low"], r["n_critical"]) == (4, 25, 12, 1, 1)
    assert N.complexity_report(g.nodes.limit(0)).first()["n"] == 0
    assert [x["id"] for x in N.complex_callables(g.nodes).collect()] == ["d", "c"]
    assert N.coverage(g.nodes).first()["pct"] == 25
    assert got(N.dead_code(g).select("id")) == [("a",)]
    assert got(N.dead_methods(g).select("id", "class_name", "total")) == [("b", "Kappa", 1)]
    assert got(N.layer_violations(g)) == [("K", "Presentation", "d", "Data")]
    assert {x["id"]: (x["n_out"], x["n_in"]) for x in N.degrees(g).collect()}["a"] == (3, 2)
    assert N.importance(g).first()["importance"] >= 13
    assert got(N.class_coverage(g))[0][:3] == ("K", "Kappa", 2)


def test_graph_diff(g, spark):
    new = graph(spark, [("a", "Method", "alpha", "src/x/a.cs", 1, 10, True, True, None, 4), ("z", "File", "z", "z")], [("a", "b", "CALLS"), ("a", "z", "CALLS")])
    nodes, edges = N.graph_diff(g, new, ["name", "complexity"])
    d = {x["id"]: (x["change"], x["properties"]) for x in nodes.collect()}
    assert d["a"] == ("modified", ["complexity"]) and d["z"] == ("added", []) and d["b"] == ("removed", [])
    assert ("a", "z", "CALLS", "added") in got(edges) and len(got(edges)) == 11


def test_history(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [(f"c{i}", t + dt.timedelta(days=i), f"dev{i % 2}", "m", f, 5, 1) for i in range(4) for f in ("x", "y")] + [("c9", t, "dev0", "m", "x", 1, 1)] + [("big", t, "dev0", "m", f"f{i}", 1, 0) for i in range(60)]
    c = spark.createDataFrame(rows, "commit string, ts timestamp, author string, email string, file string, added long, removed long")
    h = {x["file"]: x for x in N.hotspots(c).collect()}
    assert h["x"]["score"] == 1.0 and h["x"]["n_commits"] == 5 and h["x"]["churn"] == 26 and h["y"]["n_authors"] == 2
    assert got(N.coupling(c)) == [("x", "y", 4, 0.8)]
    assert {x["file"]: (x["primary_author"], x["pct"]) for x in N.ownership(c).collect()}["y"] == ("dev0", 50.0)
    assert N.health(c).first()["grade"] == "A" and N.health(c, "cli").first()["grade"] == "A"
    assert N.health(c.limit(0)).first()["score"] == 100.0


def test_cycles_and_levels(spark):
    n = [(x, "File", x, x) for x in "abcdexyz"]
    g = graph(spark, n, [("a", "b", "IMPORTS"), ("a", "c", "IMPORTS"), ("b", "c", "IMPORTS"), ("c", "a", "IMPORTS"), ("x", "x", "IMPORTS"), ("d", "e", "IMPORTS"), ("y", "a", "IMPORTS")])
    assert got(A.cycles(g).select("component", "length", "severity", "members")) == [("a", 3, "low", ["a", "b", "c"]), ("x", 1, "low", ["x"])]
    e = g.out_edges("IMPORTS").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    assert dict(got(A.levels(e, g.nodes))) == {"e": 0, "x": 0, "z": 0, "d": 1, "a": 2, "b": 2, "c": 2, "y": 2}


def test_clones(spark):
    body = "function f(a, b) { let total = 0; for (const x of a) { if (x > %s) { total += x * b; log('%s'); } } return total + %s; }"
    t = [("1", body % (1, "p", 2)), ("2", "// note\n" + body % (9, "q", 7)), ("3", body.replace("f(a, b)", "g(u, v)") % (3, "z", 4)), ("4", "short"), ("5", None), ("6", " ".join(f"{c};" for c in "+-*/%&|^~!?:<>=.,()[]{}" * 3))]
    c = A.clone_clusters(spark.createDataFrame(t, "id string, text string")).collect()
    assert {x["id"]: x["cluster"] for x in c} == {"1": "1", "2": "1", "3": "1"} and c[0]["size"] == 3
    assert A.clone_tokens("a = 'x' + 12 // c") == ["ID", "=", "LIT", "+", "LIT"]


def test_clones_below_an_outlying_lead(spark):
    body = "function f(a, b) { let total = 0; for (const x of a) { if (x > 1) { total += x * b; } } return total + 2; }"
    far = body + " class @ # ~ ^ % & | ! ? static async await yield import export switch case default break continue throw"
    near = "do while " + body  # 2 of more than 20 tokens differ
    t = [("0", far), *((f"{i}", body) for i in range(1, 6)), ("6", near), ("7", far.replace("class", "enum struct new"))]
    got_ = {x["id"]: (x["cluster"], x["size"]) for x in A.clone_clusters(spark.createDataFrame(t, "id string, text string")).collect()}
    words = {i: set(A.clone_tokens(x)) for i, x in t}
    assert len(words["1"] & words["0"]) / len(words["1"] | words["0"]) < 0.9  # the lead is far from the rest
    reach = {i for i in words if len(words["1"] & words[i]) >= 0.9 * len(words["1"] | words[i])}
    assert {"1", "2", "3", "4", "5"} <= reach and got_ == {i: ("1", len(reach)) for i in reach} | {i: ("0", 2) for i in "07" if len(words["0"] & words["7"]) >= 0.9 * len(words["0"] | words["7"])}


def test_communities_and_flows(spark):
    n = [(f"{s}{i}", "Function", f"{s}{i}", f"src/{s}/f.ts", None, None, i == 0) for s in "pq" for i in range(4)]
    e = [(f"{s}{i}", f"{s}{j}", "CALLS") for s in "pq" for i in range(4) for j in range(i + 1, 4)] + [("p3", "q0", "CALLS")]
    g = graph(spark, n, e)
    m = {x["id"]: x["community"] for x in A.communities(g).collect()}
    assert len({m[f"p{i}"] for i in range(4)}) == 1 and len({m[f"q{i}"] for i in range(4)}) == 1 and m["p0"] != m["q0"]
    assert {x["name"] for x in A.community_names(A.communities(g), g.nodes).collect()} == {"p", "q"}
    assert A.entry_points(g).first()["id"] == "p0"
    p = A.processes(g, A.communities(g)).where("process_id = 'Process:1'").orderBy("k").collect()
    assert [x["id"] for x in p] == ["p0", "p1", "p2", "p3", "q0", "q1", "q2", "q3"] and p[0]["kind"] == "cross_community" and p[0]["name"] == "p0 -> q3"
    assert A.communities(graph(spark, n, [])).count() == 0


def test_frameworks_and_name_scores(spark):
    from codeloom.functions import kernels as K

    d = spark.createDataFrame([("web/app/x/page.tsx", "main"), ("src/pages/a.js", "handleClick"), ("x/routes/u.ts", "issue"), ("c/controllers/U.java", "isReady"), ("shop/views.py", None), (None, "get_all")], "path string, name string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in d.select("path", "name", K.framework_of(F.col("path"))["multiplier"], K.name_score(F.col("name"))).collect()}
    assert got == {("web/app/x/page.tsx", "main"): (2.0, 1.0), ("src/pages/a.js", "handleClick"): (1.8, 0.7), ("x/routes/u.ts", "issue"): (1.5, None), ("c/controllers/U.java", "isReady"): (None, 0.1), ("shop/views.py", None): (1.8, None), (None, "get_all"): (None, 0.15)}


def test_embedding_hook(spark):
    from codeloom.operators import search as S

    def load():
        def model(texts):
            if "boom" in texts:
                raise RuntimeError("no model")
            return [[3.0, 4.0] if t == "a" else [0.0, 0.0] if t == "z" else [1.0] for t in texts]

        return model

    d = spark.createDataFrame([("1", "a"), ("2", "z"), ("3", "short"), ("4", "boom"), ("5", None)], "node_id string, text string")
    got = {r["node_id"]: [round(x, 4) for x in r["embedding"]] for r in S.embed_nodes(d, load, 2, batch=1).collect()}
    assert got == {"1": [0.6, 0.8], "2": [0.0, 0.0], "3": [0.0, 0.0], "4": [0.0, 0.0], "5": [0.0, 0.0]}
    assert [S.clamp(x, 20, 100) for x in (None, 0, 7, 1000)] == [20, 1, 7, 100]


def test_flows_and_paths(spark):
    from codeloom.graph import PropertyGraph

    n = spark.createDataFrame([(x, "Process" if x == "P" else "Method", x, f"f/{x}.py") for x in "ABCDP"], "id string, label string, name string, file_path string")
    e = spark.createDataFrame([("1", "A", "B", "CALLS", None), ("2", "B", "C", "CALLS", None), ("3", "A", "C", "CALLS", None), ("4", "C", "D", "CALLS", None), ("5", "A", "P", "STEP_IN_PROCESS", 1), ("6", "B", "P", "STEP_IN_PROCESS", 2)], "id string, source_id string, target_id string, type string, step int")
    g = PropertyGraph(n, e)
    assert sorted((r["id"], r["depth"], "".join(r["path"])) for r in T.impact_paths(g, "D").collect()) == [("A", 2, "DCA"), ("B", 2, "DCB"), ("C", 1, "DC")]
    assert sorted(r["id"] for r in T.induced(g, T.impact_paths(g, "D").select("id")).collect()) == ["1", "2", "3"]
    assert [(r["k"], r["id"]) for r in T.process_flow(g, 3).orderBy("k").collect()] == [(1, "A"), (2, "B"), (3, "C")]
    assert [r["id"] for r in T.process_steps(g, "P").orderBy("k").collect()] == ["A", "B"] and T.process_steps(g, "Q").count() == 0


def test_index_scores_as_the_scan_does(spark, tmp_path):
    from codeloom.operators import search as S

    d = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, ""), (4, None), (5, "green tree fox fox fox")], "id long, text string")
    S.write_index(d, "id", F.col("text"), str(tmp_path / "ix"))
    for q in ("fox red red", "tree", "nothing", "  "):
        got = {r["id"]: round(r["score"], 9) for r in S.search_index(spark, str(tmp_path / "ix"), "id", q).collect()}
        assert got == {r["id"]: round(r["score"], 9) for r in S.bm25(d, "id", F.col("text"), q).collect()}
    plan = S.search_index(spark, str(tmp_path / "ix"), "id", "fox")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_labels_and_types_reach_the_scan(spark):
    import os

    from codeloom.graph import code_graph

    sf = "/root/testdata/sf0.001"
    if not os.path.exists(f"{sf}/nodes.parquet"):
        pytest.skip("no test data here")
    g = code_graph(spark, sf)
    assert "EqualTo(label,Method)" in g.label("Method")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(rel_type,CALLS)" in g.out_edges("CALLS")._jdf.queryExecution().executedPlan().toString()


def test_short_cycles(spark):
    n = spark.createDataFrame([(x, "File", x, x) for x in "abcde"], "id string, label string, name string, file_path string")
    e = spark.createDataFrame([(str(i), a, b, "IMPORTS") for i, (a, b) in enumerate(["ab", "ba", "bc", "ca", "cd", "dd", "de"])], "id string, source_id string, target_id string, type string")
    assert [(r["length"], "".join(r["members"])) for r in A.short_cycles(PropertyGraph(n, e)).collect()] == [(1, "d"), (2, "ab"), (3, "abc")]
