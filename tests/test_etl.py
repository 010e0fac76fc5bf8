import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from codeloom.graph import PropertyGraph
from codeloom.operators import etl as E
from codeloom.sources import interchange as I
from codeloom.streaming import watch as W

FILE = "file_path string, content string, extra int"


def got(df):
    return sorted(tuple(r) for r in df.collect())


def files(spark, *rows):
    return spark.createDataFrame([(p, c, 1) for p, c in rows], FILE)


def test_todos(spark):
    f = files(spark, ("a.py", "# TODO: one\nx = 'TODO two'\n  // FIXME(bob) three\r\n<!-- HACK four -->\n# TODOS no\n-- XXX\n * TODO five"), ("b.py", None), ("c.py", ""))
    assert got(E.todos(f)) == [("a.py", 1, "TODO", "one"), ("a.py", 3, "FIXME", "bob) three"), ("a.py", 4, "HACK", "four -->"), ("a.py", 6, "XXX", ""), ("a.py", 7, "TODO", "five")]
    assert [x["kind"] for x in E.todo_order(E.todos(f)).collect()][:2] == ["FIXME", "HACK"]


def test_endpoints(spark):
    f = files(spark, ("s.js", "app.get('/users/', list)\nrouter.post(\"/x\", h)\napp.get('/users', again)"), ("p.py", "@app.route('/home')\n@router.delete('/d/1/')"), ("S.java", '@GetMapping("/spring")\n@RequestMapping(value = "/r", method = RequestMethod.PUT)'), ("src/app/(x)/u/[id]/route.ts", "export async function GET() {}"))
    e = E.endpoints(f)
    assert got(e.select("http_method", "route", "framework")) == [("DELETE", "/d/1", "python"), ("GET", "/home", "python"), ("GET", "/spring", "spring"), ("GET", "/u/:id", "next"), ("GET", "/users", "express"), ("POST", "/x", "express"), ("PUT", "/r", "spring")]
    assert E.filter_endpoints(e, "get", "USER").count() == 1


def test_env(spark):
    f = files(spark, (".env", "API_KEY=1\n# NO=2\nUNUSED=3"), ("a.js", "process.env.API_KEY; process.env['API_KEY']"), ("b.py", "os.getenv('OTHER')"))
    assert got(E.env_inventory(f).select("name", "used_in_count", "unused", "undeclared")) == [("API_KEY", 2, False, False), ("OTHER", 1, False, True), ("UNUSED", 0, True, False)]


def test_env_of_other_files(spark):
    f = files(spark, ("x/application.properties", "a.b = 1\n# c=2"), ("application.yml", "top: 1\n  inner: 2\nother :\n"), ("appsettings.Dev.json", '{\n "Conn": "x",\n  "In": { "Er": 1 }\n}'), ("config.toml", "KEY=1\nlow=2"), ("vendor/.env", "GONE=1"), ("C.cs", 'Configuration["Conn"]; Environment.GetEnvironmentVariable("KEY")'), ("J.java", "System.getenv('a.b')"))
    assert got(E.env_inventory(f).select("name", "used_in_count", "declared_in")) == [("Conn", 1, "appsettings.Dev.json"), ("In", 0, "appsettings.Dev.json"), ("KEY", 1, "config.toml"), ("a.b", 1, "x/application.properties"), ("other", 0, "application.yml"), ("top", 0, "application.yml")]


def test_orm(spark):
    prisma = "model User {\n  id Int @id\n  name String?\n  posts Post[]\n}\nmodel Post {\n  id Int @id // key\n  author User\n}\n"
    rows = got(E.db_columns(files(spark, ("db/schema.prisma", prisma))).select("table_name", "column_name", "column_type", "is_primary_key", "is_nullable", "references_table"))
    assert rows == [("Post", "author", "User", False, False, "User"), ("Post", "id", "Int", True, False, None), ("User", "id", "Int", True, False, None), ("User", "name", "String", False, True, None), ("User", "posts", "Post", False, False, "Post")]
    py = "class A(Base):\n    __tablename__ = 'as'\nclass B(db.Model):\n    pass\nclass C:\n    __tablename__ = 'no'\n"
    ts = "@Entity('users')\nexport class U {}\n@Entity()\nexport class V {}\nexport class W {}\n"
    assert got(E.mapped_classes(files(spark, ("m.py", py), ("e.ts", ts), ("x.ts", None))).drop("file_path")) == [("A", "as"), ("B", "B"), ("U", "users"), ("V", "V")]


def test_supertypes():
    assert E.supertypes(" extends Base<T, U> implements A, b.C ", "java") == (["Base"], ["A", "C"])
    assert E.supertypes(" : Base, IThing, INext<int> where T : class", "csharp") == (["Base"], ["IThing", "INext"])
    assert E.supertypes(" < Mod::Base", "ruby") == (["Base"], []) and E.supertypes("", "java") == ([], [])


def test_lint_sections():
    long = "word " * 60
    assert E.short_sections(f"# A\n{long}\n## B\nfew\n# C\nfew\n```\n# no\n```\n") == [5]
    assert E.short_sections("") == [] and E.short_sections(None) == []


def test_lint(spark):
    d = spark.createDataFrame([("docs/user_service.md", "TODO\n[x](gone.md) [y](ok.md)\n<!-- FILL: it -->"), ("docs/ok.md", "# Title\nfew"), ("docs/none.md", None)], "source_path string, content string")
    assert got(E.lint(d).select("kind", "severity", "source_path", "line").fillna(0)) == [("broken_link", "RED", "docs/user_service.md", 2), ("missing_section", "YELLOW", "docs/user_service.md", 0), ("residual_todo", "RED", "docs/user_service.md", 1), ("short_section", "YELLOW", "docs/ok.md", 1), ("unfilled_anchor", "RED", "docs/user_service.md", 3)]


def test_names_of_several_words_and_byte_chunks(spark):
    c = spark.createDataFrame([("d", 0, "Calls Space::OuterName and PlainName, not XPlainName")], "source_path string, chunk_index int, content string")
    n = spark.createDataFrame([("1", "Class", "Space::OuterName"), ("2", "Class", "PlainName"), ("3", "Class", "Other::OuterName")], "id string, label string, name string")
    assert got(E.mentions(c, n).select("id")) == [("1",), ("2",)]
    f = spark.createDataFrame([(f"p{i:02}", 10) for i in range(20)], "path string, size long")
    k = {r["path"]: r["chunk"] for r in E.byte_chunks(f, 50).collect()}
    assert k == {f"p{i:02}": i * 10 // 50 for i in range(20)}


def test_field_types_come_first(spark):
    d = lambda rows, s: spark.createDataFrame(rows, s)
    calls = d([(1, "a.cs", "Save", 1, "_svc"), (2, "a.cs", "Save", 1, "Store"), (3, "a.cs", "Save", 3, None), (4, "a.ts", "Save", None, "_svc")], "call_id long, file string, name string, n_args int, receiver string")
    sym = d([("m1", "Mail.cs", "Save", True, 1, 1, "Mail", "method"), ("m2", "Store.cs", "Save", True, 3, 3, "Store", "method"), ("t", "Store.cs", "Store", True, None, None, None, "type")], "id string, file string, name string, is_exported boolean, required int, params int, owner string, kind string")
    none = d([], "file string, name string, source_file string, source_name string")
    r = E.resolve(calls, sym, none, d([], "file string, imported string"), d([], "file string, package string"), d([("a.cs", "_svc", "IMail")], "file string, field string, type string"))
    assert got(r) == [(1, "m1", "field_type", 0.85), (2, "m2", "static_class", 0.8), (3, "m2", "global", 0.5), (4, "m1", "global", 0.5)]


def test_ddl(spark):
    sql = "CREATE TABLE IF NOT EXISTS users (id INT PRIMARY KEY, name VARCHAR(10) NOT NULL, org_id INT REFERENCES orgs(id), x DECIMAL(3, 2), FOREIGN KEY (x) REFERENCES xs(id)); -- create table no (a int)\ncreate table b (a int, c int, primary key (a, c));"
    rows = E.parse_ddl(sql)
    assert ("users", "id", "INT", True, False, None) in rows and ("users", "name", "VARCHAR(10)", False, False, None) in rows and ("users", "org_id", "INT", False, True, "orgs") in rows and ("users", "x", "DECIMAL(3, 2)", False, True, "xs") in rows and ("b", "c", "int", True, False, None) in rows and len(rows) == 6
    assert got(E.db_tables(E.db_columns(files(spark, ("s.sql", sql), ("n.sql", None))))) == [("b", 2, 0), ("users", 4, 2)]


def test_manifest(spark):
    a, b = E.manifest(files(spark, ("x", "1"), ("y", "2"))), E.manifest(files(spark, ("y", "3"), ("z", "4")))
    assert got(E.manifest_diff(a, b)) == [("x", "removed"), ("y", "modified"), ("z", "added")]


def test_structure(spark):
    n, e = E.structure(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",), ("e.py",)], "path string"))
    assert [x[0] for x in got(n.select("id"))] == ["File:a/b/c.py", "File:a/d.py", "File:e.py", "Folder:a", "Folder:a/b"]
    assert got(e.select("source_id", "target_id")) == [("Folder:a", "File:a/d.py"), ("Folder:a", "Folder:a/b"), ("Folder:a/b", "File:a/b/c.py")]


def test_chunks(spark):
    text = "intro\n# One\nbody\n```\n# no heading\n```\n## Two\n" + "\n\n".join(["p" * 2500] * 4) + "\n# End"
    c = E.chunk_markdown(text)
    assert [x[0] for x in c] == ["Document Start", "One", "Two (part 1/2)", "Two (part 2/2)", "End"] and c[4][1] == "" and "# no heading" in c[1][1]
    assert E.chunk_markdown("") == [] and E.chunk_markdown(None) == []
    d = spark.createDataFrame([("a", "# T\ncalls handleLogin()"), ("b", None)], "source_path string, content string")
    n = spark.createDataFrame([("f", "Function", "handleLogin"), ("g", "Function", "call")], "id string, label string, name string")
    assert got(E.mentions(E.chunks(d), n)) == [("a", 0, "f")]
    docs = spark.createDataFrame([("d/a.md", "TODO x\n[l](b.md) [m](none.md) [w](https://x/y.md)\n<!-- GX: a -->"), ("d/b.md", "fine")], "source_path string, content string")
    assert got(E.lint(docs).select("kind", "line")) == [("broken_link", 2), ("residual_todo", 1), ("unfilled_anchor", 3)]


def test_resolution_tiers(spark):
    sym = spark.createDataFrame([("1", "a", "f", False, 0, 2), ("2", "b", "f", True, 0, 2), ("3", "b", "g", True, 1, 1), ("4", "p/x", "h", True, 0, 9), ("5", "z", "k", True, 0, 0), ("6", "z", "k", True, 1, 3), ("7", "z", "secret", False, 0, 0), ("8", "q", "orig", False, 0, 0)], "id string, file string, name string, is_exported boolean, required int, params int")
    calls = spark.createDataFrame([("c1", "a", "f", 1), ("c2", "a", "g", 1), ("c3", "a", "h", 1), ("c4", "a", "k", 2), ("c5", "a", "secret", 0), ("c6", "a", "alias", 0)], "call_id string, file string, name string, n_args int")
    named = spark.createDataFrame([("a", "alias", "q", "orig")], "file string, name string, source_file string, source_name string")
    imports, packages = spark.createDataFrame([("a", "b")], "file string, imported string"), spark.createDataFrame([("a", "p")], "file string, package string")
    r = {x["call_id"]: (x["target_id"], x["tier"], x["confidence"]) for x in E.resolve(calls, sym, named, imports, packages).collect()}
    assert r == {"c1": ("1", "same_file", 1.0), "c2": ("3", "import_scoped", 0.8), "c3": ("4", "package_scoped", 0.7), "c4": ("6", "global", 0.5), "c6": ("8", "named_import", 0.95)}


def metric(df, name):
    """The greatest value of a metric in the plan of a query that has run."""
    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        m = p.metrics().get(name)
        return max([m.get().value() if m.isDefined() else 0, *(walk(p.children().apply(i)) for i in range(p.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_resolution_pairs_no_call_with_all_symbols_of_its_name(spark):
    n = spark.range(1500)
    text = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string"))
    sym = n.select(text("s").alias("id"), F.concat(text("lib/m"), F.lit("/x.py")).alias("file"), F.lit("run").alias("name"), F.lit(True).alias("is_exported"), F.lit(0).alias("required"), (F.col("id") % 5).cast("int").alias("params"))
    calls = n.select(text("c").alias("call_id"), text("src/f").alias("file"), F.lit("run").alias("name"), F.lit(4).alias("n_args"))
    none = spark.createDataFrame([], "file string, name string, source_file string, source_name string")
    imports, packages = spark.createDataFrame([], "file string, imported string"), spark.createDataFrame([("src/f7", "lib"), ("src/f8", "m3"), ("src/f9", "gone")], "file string, package string")
    r = E.resolve(calls, sym, none, imports, packages)
    got_ = {x["call_id"]: (x["target_id"], x["tier"]) for x in r.collect()}
    assert got_ == {f"c{i}": ("s1004", "global") for i in range(1500)} | {"c7": ("s1004", "package_scoped"), "c8": ("s3", "package_scoped")}
    assert metric(r, "numOutputRows") < 20_000


def test_packages_are_runs_of_whole_parts(spark):
    paths, names = ["a/b/a/x", "/b/x", "a//b/x", "ab/c", "x", "", "b", "a/b", "b/"], ["a", "b", "", "a/b", "b/a", "/b", "x", "a/", "/", "ab", "//", "b/a/x"]
    sym = spark.createDataFrame([(f"s{i}", p, f"n{i}", True, 0, 1) for i, p in enumerate(paths)], "id string, file string, name string, is_exported boolean, required int, params int")
    calls = spark.createDataFrame([(f"{j}-{i}", f"caller{j}", f"n{i}", 1) for j in range(len(names)) for i in range(len(paths))], "call_id string, file string, name string, n_args int")
    packages = spark.createDataFrame([(f"caller{j}", p) for j, p in enumerate(names)], "file string, package string")
    r = E.resolve(calls, sym, spark.createDataFrame([], "file string, name string, source_file string, source_name string"), spark.createDataFrame([], "file string, imported string"), packages)
    within = {f"{j}-{i}" for j, p in enumerate(names) for i, f in enumerate(paths) if f == p or f.startswith(p + "/") or f"/{p}/" in f}
    assert {x["call_id"] for x in r.where("tier = 'package_scoped'").collect()} == within


def test_mentions_shuffle_no_pairs(spark):
    text = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string"))
    c = spark.range(100).select(text("d").alias("source_path"), F.lit(0).alias("chunk_index"), F.lit("calls runBatch, then runBatch").alias("content"))
    c = c.unionByName(c.where("source_path = 'd7'"))
    n = spark.range(200).select(text("m").alias("id"), F.lit("Method").alias("label"), F.lit("runBatch").alias("name"))
    r = E.mentions(c, n)
    assert sorted((x["source_path"], x["id"]) for x in r.collect()) == sorted((f"d{i}", f"m{j}") for i in range(100) for j in range(200))
    assert 0 < metric(r, "shuffleRecordsWritten") < 1_000


def test_mentions_of_ids_with_several_names(spark):
    c = spark.createDataFrame([("d", 0, "Space::OuterName and PlainName"), ("e", 0, "PlainName"), ("e", 0, "OuterName"), ("f", 0, None)], "source_path string, chunk_index int, content string")
    n = spark.createDataFrame([("1", "Class", "Space::OuterName"), ("1", "Struct", "PlainName"), ("2", "Class", "PlainName"), ("2", "Class", "PlainName"), ("3", "Class", "OuterName"), ("4", "File", "PlainName"), ("5", "Class", None)], "id string, label string, name string")
    assert got(E.mentions(c, n)) == [("d", 0, "1"), ("d", 0, "2"), ("d", 0, "3"), ("e", 0, "1"), ("e", 0, "2"), ("e", 0, "3")]


def test_extraction(spark):
    py = "class A(Base):\n    def m(self, x):\n        if x and x > 1:\n            return 1\n\ndef f(a, b=2):\n    return [i for i in a if i]\n"
    ts = "export class C extends D {\n  run(a, b) {\n    if (a && b) {\n      return 1;\n    }\n  }\n}\nfunction g(x) {\n}\n"
    f = spark.createDataFrame([("a.py", py), ("b.ts", ts), ("bad.py", "def ("), ("n.xyz", "x"), ("node_modules/z.js", "function q() {}")], "path string, content string")
    s = E.extract(E.scan(f))
    assert sorted((tuple(r) for r in s.selectExpr("file_path", "label", "name", "owner", "get(bases, 0)").collect()), key=lambda t: t[:3]) == sorted([("a.py", "Class", "A", None, "Base"), ("a.py", "Method", "m", "A", None), ("a.py", "Function", "f", None, None), ("b.ts", "Class", "C", None, "D"), ("b.ts", "Method", "run", "C", None), ("b.ts", "Function", "g", None, None)], key=lambda t: (t[0], t[1], t[2]))
    c = {(x["file_path"], x["name"]): (x["complexity"], x["parameter_count"]) for x in s.collect()}
    assert c[("a.py", "m")] == (3, 1) and c[("a.py", "f")] == (2, 2) and c[("b.ts", "run")] == (3, 2) and ("b.ts", "g") in c and len(c) == 6
    more = E.extract(E.scan(spark.createDataFrame([("c.java", "class K extends L implements M, N {\n}\nclass L {\n}\ninterface M {\n}\n")], "path string, content string")))
    assert got(E.graph_tables(more)[1].where("type in ('EXTENDS', 'IMPLEMENTS')").select("source_id", "type", "target_id")) == [("Class:c.java:K", "EXTENDS", "Class:c.java:L"), ("Class:c.java:K", "IMPLEMENTS", "Interface:c.java:M")]
    n, e = E.graph_tables(s)
    assert n.count() == 6 and ("Class:a.py:A", "Method:a.py:m", "HAS_METHOD") in got(e.select("source_id", "target_id", "type"))


def test_traces(spark):
    assert E.parse_trace('[{"method": "A.b"}]') == ["A.b"] and E.parse_trace('{"method": "X.y"}\n{"method": "Z.w"}') == ["X.y", "Z.w"]
    assert E.parse_trace("[1] START OrderService.Save\n===== EF INSERT =====\n[2] START file.cs") == ["OrderService.Save", "Database.Insert"] and E.parse_trace(None) == []
    log = spark.createDataFrame([("10 OrderService.save took", ), ("Foo.Bar (1)",), ("UserController.x Foo.Bar(1)",)], "text string")
    assert got(E.log_counts(log)) == [("Foo.Bar", 1), ("OrderService.save", 1), ("UserController.x", 1)]
    nodes = spark.createDataFrame([("1", "Method", "save", "a/OrderService.cs", None), ("2", "Method", "save", "a/Other.cs", True)], "id string, label string, name string, file_path string, is_traced boolean")
    steps = spark.createDataFrame([(1, "OrderService.save"), (2, "nothing")], "step int, method string")
    assert got(E.resolve_trace(steps, nodes)) == [(1, "OrderService.save", "1"), (2, "nothing", None)]
    assert got(E.import_trace(nodes, spark.createDataFrame([("1", 2), ("1", 3)], "id string, n int"))) == [("1", True, 5), ("2", True, 0)]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame([("f1", "Function", 'a"b', "x.ts", "line1\nline2, \"q\"", 1, 2, "ts", True), ("c1", "Class", "C", "y.ts", "bin\x01\x02\x03", None, None, None, None)], "id string, label string, name string, file_path string, content string, start_line long, end_line long, language string, is_exported boolean")
    e = spark.createDataFrame([("e1", "f1", "c1", "CALLS", 0.95, None, 3)], "id string, source_id string, target_id string, type string, confidence double, reason string, step int")
    return PropertyGraph(n, e)


def test_parquet_and_csv(g, spark, tmp_path):
    I.write_graph(g, str(tmp_path / "g"))
    r = I.read_graph(spark, str(tmp_path / "g"))
    assert r.nodes.count() == 2 and "PartitionFilters: [isnotnull(label" in r.label("Class")._jdf.queryExecution().executedPlan().toString()
    I.write_csv(g, str(tmp_path / "c"))
    c = I.read_csv(spark, str(tmp_path / "c"))
    x = {r["id"]: r for r in c.nodes.collect()}
    assert x["f1"]["content"] == 'line1\nline2, "q"' and x["f1"]["name"] == 'a"b' and x["c1"]["content"] == "[binary content]" and c.edges.first()["confidence"] == 0.95


def test_snapshot(spark, tmp_path):
    doc = {"nodes": {"a": {"id": "a", "label": "Function", "properties": {"name": "a", "filePath": "x.ts", "startLine": 3, "isExported": True}}}, "relationships": {"r": {"id": "r", "sourceId": "a", "targetId": "b", "type": "CALLS", "confidence": 0.5, "reason": "", "step": None}}}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    s = I.read_snapshot(spark, str(tmp_path / "s.json"))
    n, e = s.nodes.first(), s.edges.first()
    assert (n["name"], n["file_path"], n["start_line"], n["is_exported"]) == ("a", "x.ts", 3, True) and (e["source_id"], e["type"]) == ("a", "CALLS")


def test_embeddings(spark, tmp_path):
    rows = [("n1", [1.0, 2.0, 0.5]), ("né", [0.0, -1.0, 4.0])]
    blob = I.encode_embeddings(rows)
    assert I.decode_embeddings(blob) == rows
    (tmp_path / "e.bin").write_bytes(blob)
    assert got(I.read_embeddings(spark, str(tmp_path / "e.bin"))) == sorted(rows)
    with pytest.raises(ValueError):
        I.decode_embeddings(b"WRONGMAG" + blob[8:])


def test_logs_and_exports(g, spark, tmp_path):
    log = ["COMMIT:h1|2025-01-02T03:04:05+00:00|Ann|a@x.org", "", "3\t1\tsrc/a.py", "-\t-\tbin.png", "COMMIT:h2|2025-01-03T00:00:00+00:00|Bob|b@x.org", "1\t0\tsrc/a.py"]
    d = spark.createDataFrame([("l", i, t) for i, t in enumerate(log)], "log string, line int, text string")
    assert got(I.parse_git_log(d).select("commit", "author", "file", "added", "removed")) == [("h1", "Ann", "bin.png", 0, 0), ("h1", "Ann", "src/a.py", 3, 1), ("h2", "Bob", "src/a.py", 1, 0)]
    diff = ["--- a/x.py", "+++ b/x.py", "@@ -1,2 +3,4 @@", "@@ -9 +12 @@", "+++ b/y.py", "@@ -5,2 +4,0 @@"]
    p = spark.createDataFrame([("l", i, t) for i, t in enumerate(diff)], "log string, line int, text string")
    assert got(I.parse_diff(p)) == [("x.py", 3, 6), ("x.py", 12, 12), ("y.py", 4, 4)]
    assert '  "f1" [label="Function: a\\"b"];' in {x[0] for x in I.dot_lines(g).select("value").collect()} and I.json_lines(g).count() == 3
    (tmp_path / "t" / "d").mkdir(parents=True)
    (tmp_path / "t" / "d" / "a.py").write_text("x = 1\n")
    assert got(I.read_source_tree(spark, str(tmp_path / "t"))) == [("d/a.py", "x = 1\n")]
    r = spark.createDataFrame([("a", "/p", "2025"), ("a", "/q", "2024"), ("b", "/r", "2023")], "name string, path string, indexed_at string")
    assert got(I.registry(r)) == [("a", "/p", "2025"), ("b", "/r", "2023")] and I.registry(r, "/r").count() == 1


def event(path, content, n, gone=False):
    return (path, content, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n), gone)


def test_incremental(spark):
    empty = PropertyGraph(spark.createDataFrame([], "id string, label string, name string, file_path string, language string, start_line long, end_line long, parameter_count long, complexity long"), spark.createDataFrame([], "id string, source_id string, target_id string, type string"))
    a = W.incremental_update(empty, spark.createDataFrame([event("a.py", "def f():\n    pass\n", 1), event("b.py", "def g():\n    pass\n", 1)], W.FILES))
    e = spark.createDataFrame([("x", "Function:b.py:g", "Function:a.py:f", "CALLS"), ("y", "Function:b.py:g", "Function:a.py:gone", "CALLS")], "id string, source_id string, target_id string, type string")
    a = PropertyGraph(a.nodes, a.edges.unionByName(e))
    b = W.incremental_update(a, spark.createDataFrame([event("a.py", "old", 1), event("a.py", "def f():\n    return 2\ndef h():\n    pass\n", 2), event("c.py", None, 1, True)], W.FILES))
    assert {x["name"] for x in b.nodes.collect()} == {"f", "g", "h"}
    assert "x" in {x["id"] for x in b.edges.collect()}, "an edge from an unchanged file stays"
    c = W.incremental_update(b, spark.createDataFrame([event("a.py", None, 9, True)], W.FILES))
    assert {x["name"] for x in c.nodes.collect()} == {"g"}


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    (tmp_path / "in" / "1.json").write_text(json.dumps({"path": "a.py", "content": "x", "modified": "2025-01-01T00:00:00Z", "is_deleted": False}) + "\n")
    for _ in range(2):
        q = W.watch(spark, str(tmp_path / "in"), lambda b, i: seen.append((i, [r["path"] for r in b.collect()])), str(tmp_path / "cp"), {"availableNow": True})
        q.awaitTermination()
        (tmp_path / "in" / "2.json").write_text(json.dumps({"path": "b.py", "content": "y", "modified": "2025-01-01T00:00:01Z", "is_deleted": False}) + "\n")
        time.sleep(0.1)
    assert [p for _, p in seen] == [["a.py"], ["b.py"]]


def test_sessions(spark):
    t = dt.datetime(2025, 1, 1)
    e = spark.createDataFrame([(1, t, "v", 1.0), (1, t + dt.timedelta(minutes=20), "v", 1.0), (1, t + dt.timedelta(minutes=60), "v", 1.0), (2, t, "v", 1.0)], "user_id long, ts timestamp, event_type string, value double")
    assert got(W.sessions(e).select("user_id", "n")) == [(1, 1), (1, 2), (2, 1)]
    assert got(W.windowed_counts(e).select("event_type", "n"))[0] == ("v", 4)


def test_views(spark):
    from codeloom.operators import views as V

    n = spark.createDataFrame([("a", "Method", "load", "src/a/x.py", None), ("f", "File", "x.py", "src/a/x.py", None), ("g", "File", "y.py", "src/ab/y.py", None), ("e", "DbEntity", "Order", "db", None), ("C", "Community", "core", "c", None), ("d", "DocChunk", "doc", "d", "t" * 900)], "id string, label string, name string, file_path string, content string")
    e = spark.createDataFrame([("1", "a", "P", "STEP_IN_PROCESS", None), ("2", "a", "e", "ACCESSES", "write"), ("3", "a", "e", "ACCESSES", "READ"), ("4", "a", "C", "MEMBER_OF", None), ("5", "d", "a", "MENTIONS", None)], "id string, source_id string, target_id string, type string, reason string")
    g = PropertyGraph(n, e)
    assert got(V.under(n, "src/a").select("id")) == [("a",), ("f",)] and got(V.glob_files(g, "src/*/?.py").select("id")) == [("f",), ("g",)] and got(V.glob_files(g, "**/y.py").select("id")) == [("g",)]
    assert got(V.process_entities(g)) == [("P", "e", "Order", "read+write")] and got(V.features(g)) == [("C", "core", 1)]
    assert got(V.evidence(g, n.where("id = 'a'"))) == [("d", "a")] and V.marker_probes(n, {"x": "LOAD", "y": "zzz"}).first() == (True, False)
    assert ("community", "C", "core") in got(V.insights(g, "a")) and [x["id"] for x in V.find_names(n, "^x").collect()] == ["f"]
    assert V.retrieve(n, "load").first()["id"] == "a"
    near = spark.createDataFrame([("d", 1), ("a", 2)], "id string, rank int")
    assert len(V.doc_chunks(n, near).first()["excerpt"]) == 600 and V.retrieve(n, "load", near=near).first()["id"] == "a"
    i = spark.createDataFrame([("m.js", "../lib/store"), ("m.py", "pkg.mod"), ("m.py", "none")], "file string, module string")
    f = spark.createDataFrame([("src/lib/store.js",), ("other/lib/store/index.js",), ("pkg/mod.py",), ("m.py",)], "path string")
    assert got(V.resolve_imports(i, f)) == [("m.js", "../lib/store", "src/lib/store.js"), ("m.py", "pkg.mod", "pkg/mod.py")]


def test_docx(spark, tmp_path):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body </w:t><w:t>text</w:t></w:r></w:p></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", doc)
    (tmp_path / "a.docx").write_bytes(b.getvalue())
    assert I.read_docx(spark, str(tmp_path)).first()["content"] == "## Title\n\nBody text"


def test_snapshot_document(g, spark, tmp_path):
    I.write_snapshot(g, str(tmp_path / "snap"))
    import glob

    text = open(glob.glob(str(tmp_path / "snap" / "part-*"))[0]).read()
    doc = json.loads(text)
    assert set(doc["nodes"]) == {r["id"] for r in g.nodes.collect()} and set(doc["relationships"]) == {r["id"] for r in g.edges.collect()}
    back = I.read_snapshot(spark, str(tmp_path / "snap"))
    assert got(back.edges.select("id", "source_id", "target_id", "type")) == got(g.edges.select("id", "source_id", "target_id", "type"))
    assert got(back.nodes.select("id", "label", "name")) == got(g.nodes.select("id", "label", "name"))


def test_batches_write_the_graph_first(spark):
    state, order = {"m": None}, []
    empty = PropertyGraph(spark.createDataFrame([], "id string, label string, name string, file_path string"), spark.createDataFrame([], "id string, source_id string, target_id string, type string"))
    state["g"] = empty
    handle = W.apply_batch(lambda x: (order.append("g"), state.update(g=x)), lambda m: (order.append("m"), state.update(m=m)), lambda: (state["g"], state["m"]), lambda x: order.append("after"), lambda step, k: order.append((step, k)))
    ev = lambda rows: spark.createDataFrame([(p, c, dt.datetime(2025, 1, 1, 0, t), d) for p, c, t, d in rows], W.FILES)
    handle(ev([("a.py", "def f():\n    pass\n", 1, False)]), 7)
    assert order == [("start", 7), "g", ("graph", 7), "m", ("manifest", 7), "after", ("after", 7)]
    handle(ev([("a.py", None, 2, True), ("b.py", "class B:\n    pass\n", 2, False)]), 8)
    assert got(state["g"].nodes.select("name")) == [("B",)] and [r[0] for r in got(state["m"].select("path"))] == ["b.py"]
