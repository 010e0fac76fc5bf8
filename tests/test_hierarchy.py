import random

from codeloom.operators import components as C
from codeloom.operators import hierarchy
from codeloom.operators.components import connected, strongly_connected
from codeloom.plans.problems import class_links, file_links

LINK = "node string, parent string, root int"


def brute(parent):
    out = {}
    for n in parent:
        path, cur = [n], n
        while cur in parent and parent[cur] is not None:
            cur = parent[cur]
            if cur in path:
                path = None
                break
            path.append(cur)
        out[n] = (path[-1], len(path) - 1, path[::-1]) if path else (None, -1, None)
    return out


def test_random_forest_with_loops(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "HEAVY_LEAST", 5)  # several heavy parents even here
    monkeypatch.setattr(hierarchy, "HEAVY_SHARE", 50)
    r = random.Random(4)
    parent = {f"n{i}": f"n{r.randrange(max(1, i - 3), i)}" if i > 5 and r.random() < 0.97 else None for i in range(300)}
    parent |= {f"w{i}": "n7" for i in range(40)} | {f"x{i}": "undeclared" for i in range(9)}
    parent |= {"l0": "l1", "l1": "l2", "l2": "l0", "below": "l1", "self": "self", "under": "below"}
    rows = [(n, p, 1) for n, p in parent.items()] + [("n10", parent["n10"], 2), (None, "n1", 3)]
    got = {x.node: (x.root, x.depth, x.path) for x in hierarchy.resolve_hierarchy(spark.createDataFrame(rows, LINK), with_paths=True).collect()}
    assert got == brute(parent)


def test_deep_chain_and_descendants(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None, 0) for i in range(200)]
    r = hierarchy.resolve_hierarchy(spark.createDataFrame(rows, LINK), with_paths=True)
    counts = {x.node: (x.n_descendants, x.height) for x in hierarchy.descendant_counts(r).collect()}
    assert counts["c0"] == (199, 199) and counts["c198"] == (1, 1) and "c199" not in counts
    assert hierarchy.descendants(r).count() == 199 * 200 // 2


def test_empty_links(spark):
    assert hierarchy.resolve_hierarchy(spark.createDataFrame([], LINK)).count() == 0


def closure(edges):
    reach = {}
    for a, b in edges:
        reach.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = set().union(*(reach.get(b, set()) for b in reach[a])) - reach[a]
            if more:
                reach[a] |= more
                changed = True
    return reach


def test_strongly_connected_random(spark):
    r = random.Random(1)
    edges = {(f"v{r.randrange(40)}", f"v{r.randrange(40)}") for _ in range(60)} | {("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("s", "s")}
    reach = closure(edges)
    want = {n: max({m for m in reach[n] if n in reach.get(m, ())} | {n}) for n in reach if n in reach[n]}
    rows = [*edges, ("a", "b"), (None, "a"), ("a", None)]
    got = {x.node: x.component for x in strongly_connected(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert got == want


def test_strongly_connected_empty(spark):
    assert strongly_connected(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert strongly_connected(spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0


def test_connected(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("z", "z"), ("a", "b")] + [(f"h{i}", "hub") for i in range(50)], "src string, dst string")
    got = {x.node: x.component for x in connected(e).collect()}
    assert got["c"] == "a" and got["y"] == "x" and got["z"] == "z" and {got[f"h{i}"] for i in range(50)} | {got["hub"]} == {"h0"}


def test_class_names_and_kinds(spark):
    rows = [("r", " Ns.Core.Foo<List<Bar>> ", "global::X.Base[T]", "extends"), ("r", "Foo", "IThing", "implements"), ("r", "Outer<A>.Inner", None, None), (None, "\\App\\Cls", "", "inherits"), ("r", None, "P", "extends"), ("r", "  ", "P", "extends")]
    got = {tuple(x) for x in class_links(spark.createDataFrame(rows, "repo string, class_name string, parent_name string, kind string")).collect()}
    assert got == {("r\u0001Foo", "r\u0001Base"), ("r\u0001Foo", None), ("r\u0001Inner", None), ("\u0001Cls", None)}


def test_file_links(spark):
    rows = [("r", ["a", "b", "a"]), ("r", ["x"]), ("r", []), ("r", None), ("q", ["m", None, "n", "n"])]
    got = {tuple(x) for x in file_links(spark.createDataFrame(rows, "repo string, cycle array<string>")).collect()}
    assert got == {("r\u0001a", "r\u0001b"), ("r\u0001b", "r\u0001a"), ("q\u0001n", "q\u0001n")}


def test_descendants_on_and_below_loops(spark):
    parent = {f"l{i}": f"l{(i + 1) % 5}" for i in range(5)} | {"below": "l1", "under": "below", "self": "self", "child": "self", "a": "b", "b": None}
    parent |= {f"c{i}": f"c{i - 1}" if i else "under" for i in range(20)}
    want = {}
    for n in parent:
        cur, d = parent[n], 1
        seen = {n}
        while cur is not None and cur not in seen:
            seen.add(cur)
            if n not in ("a", "b"):
                want[(cur, n)] = d
            cur, d = parent.get(cur), d + 1
    links = spark.createDataFrame([(n, p, 0) for n, p in parent.items()], LINK)
    got = hierarchy.loop_descendants(links, hierarchy.resolve_hierarchy(links)).collect()
    assert {(x.ancestor, x.descendant): x.distance for x in got} == want and len(got) == len(want)
    assert want[("below", "c19")] == 21 and ("under", "c0") in want


def brute_components(edges):
    """Components by reachability, of at least two nodes or with a self-loop."""
    reach = {a: {a} for e in edges for a in e}
    while True:
        grown = {a: set().union(r, *(({y} for x, y in edges if x in r))) for a, r in reach.items()}
        if grown == reach:
            break
        reach = grown
    parts = {frozenset(b for b in reach[a] if a in reach[b]) for a in reach}
    return {p for p in parts if len(p) > 1 or (min(p), min(p)) in edges}


def test_components_of_chains_loops_and_dense_parts(spark):
    r = random.Random(5)
    for n, extra in ((14, 3), (30, 50)):
        edges = set()
        for _ in range(3):
            ring = r.sample(range(n), r.randrange(1, n - 2))
            edges |= {(str(a), str(b)) for a, b in zip(ring, ring[1:] + ring[:1])}
        edges |= {(str(r.randrange(n)), str(r.randrange(n))) for _ in range(extra)} | {(x, x) for x in map(str, r.sample(range(n), n // 4))}
        got = {}
        for x in C.strongly_connected(spark.createDataFrame(sorted(edges), "src string, dst string")).collect():
            got.setdefault(x["component"], set()).add(x["node"])
        assert {frozenset(p) for p in got.values()} == brute_components(edges)


def test_long_loop_takes_few_rounds(spark, monkeypatch):
    rounds, real = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: rounds.append(1) or real(df))
    n = 5000
    e = spark.range(n).selectExpr("cast(id as string) as src", f"cast((id + 1) % {n} as string) as dst")
    assert C.strongly_connected(e).groupBy("component").count().first()["count"] == n
    assert len(rounds) < 90
