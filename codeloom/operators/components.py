"""Strongly connected components and connected components as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import is_empty
from codeloom.session import settle as materialize

SPLITTER_EVERY = 8
HEAVY_LEAST, HEAVY_SHARE = 5000, 1000
WORTH = 0.2  # share of nodes with one successor from which another contraction pays


def _is_splitter(key: Column, level: int) -> Column:
    """A fixed share of the keys, another one at every level."""
    return F.pmod(F.xxhash64(key, F.lit(level)), F.lit(SPLITTER_EVERY)) == 0


def _propagate(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Push the greatest label along (src, dst) until nothing changes. Each round moves only labels that changed."""
    state = moved = materialize(labels)
    while True:
        offers = moved.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("o_node")).agg(F.max("color").alias("offer"))
        joined = state.join(offers, F.col("node") == F.col("o_node"), "left")
        better = F.col("offer").isNotNull() & (F.col("offer") > F.col("color"))
        new = materialize(joined.select("node", F.when(better, F.col("offer")).otherwise(F.col("color")).alias("color"), F.coalesce(better, F.lit(False)).alias("changed")))
        moved = new.where("changed").select("node", "color")
        state = new.select("node", "color")
        if is_empty(moved):
            return state


def _reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, color) pairs reached from the seeds along (src, dst, color) edges of the same colour."""
    seen, n = materialize(seeds.withColumn("new", F.lit(True))), 0
    while True:
        step = seen.where("new").join(edges, (F.col("node") == F.col("src")) & (F.col("color") == F.col("e_color"))).select(F.col("dst").alias("node"), "color", F.lit(True).alias("new"))
        # a pair is new if only this round brings it; one table of what was seen, written anew each round
        seen = materialize(seen.withColumn("new", F.lit(False)).unionByName(step).groupBy("node", "color").agg(F.min("new").alias("new")))
        n, was = seen.count(), n
        if n == was:
            return seen.select("node", "color")


def _core(edges: DataFrame) -> DataFrame:
    """``node, component`` of a graph in which most nodes have several successors and predecessors, by label colouring.

    Every node takes the greatest label that reaches it; what the owner of a label reaches backwards within its colour
    is its component; repeated on what is left. Such graphs are shallow, which bounds the rounds.
    """
    left, found = edges, None
    while not is_empty(left):
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colors = _propagate(nodes.withColumn("color", F.col("node")), left)
        a, b = (colors.select(F.col("node").alias(f"{e}_n"), F.col("color").alias(f"{e}_c")) for e in ("s", "d"))
        inside = materialize(left.join(a, F.col("src") == F.col("s_n")).join(b, F.col("dst") == F.col("d_n")).where("s_c = d_c").select("src", "dst", F.col("s_c").alias("e_color")))
        mine = materialize(_reach(colors.where("node = color"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "e_color")))
        part = mine.select("node", F.col("color").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = mine.select("node")
        left = _trim(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    big = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(big, "component", "left_semi").select("node", "component")


def _trim(edges: DataFrame) -> DataFrame:
    """Without edges from nodes that nothing leads to and edges to nodes that lead nowhere, one pass each."""
    e = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return materialize(e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def _walk(start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointers (node, cur, path, open) doubled until they stand at a stop; those that never do, apart.

    Open rows go on to where their target stands. A round after which as many rows are open as before has only rows on
    loops without a stop, or below one, left.
    """
    state, before = materialize(start), None
    while True:
        live = state.where("open")
        n = live.count()
        if n == 0 or n == before:
            return state.where("not open"), live
        before = n
        j = state.select(F.col("node").alias("j_node"), F.col("cur").alias("j_cur"), F.col("path").alias("j_path"), F.col("open").alias("j_open"))
        far = live.join(j, F.col("cur") == F.col("j_node")).select("node", F.col("j_cur").alias("cur"), F.concat("path", "j_path").alias("path"), F.col("j_open").alias("open"))
        state = materialize(state.where("not open").unionByName(far))


def _loops(live: DataFrame) -> DataFrame:
    """``node, component`` of the nodes on loops without a stop, among pointers that never end.

    Doubled until every place where a pointer stands holds itself on its own way; what does is on the loop. A loop of n
    nodes has no splitter with a chance of (1 - 1/SPLITTER_EVERY)^n, so the ways stay short.
    """
    while True:
        on = live.where(F.array_contains("path", F.col("node")))
        if is_empty(live.select(F.col("cur").alias("node")).distinct().join(on.select("node"), "node", "left_anti")):
            return on.select("node", F.array_max("path").alias("component"))
        j = live.select(F.col("node").alias("j_node"), F.col("cur").alias("j_cur"), F.col("path").alias("j_path"))
        live = materialize(live.join(j, F.col("cur") == F.col("j_node")).select("node", F.col("j_cur").alias("cur"), F.array_distinct(F.concat("path", "j_path")).alias("path")))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node on a closed path of (src, dst) edges, itself included.

    Components of one node count only with a self-loop. Chains are contracted by hash splitters: of the nodes with one
    successor a share is drawn as splitters, these and all nodes with several successors are stops, and every other
    node walks to its next stop. The stops alone form the reduced graph, which is solved likewise, with the directions
    swapped where few nodes have one successor; loops without a stop are told apart. What is left when most nodes have
    several neighbours each way is coloured. Going back, a way between two stops of one component is expanded and
    joins it. So a loop of n nodes takes about log n rounds. ``component`` is the greatest key of the component.
    Null ends are ignored, repeated edges count once, an empty table gives an empty result.
    """
    left = materialize(edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).where("src is not null and dst is not null").distinct())
    loops = left.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    found = loops.limit(0)
    left = _trim(left.where("src <> dst"))
    ways, level, swapped = [], 0, False
    while True:
        degree = materialize(left.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("next")))
        nodes, chained = degree.agg(F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
        if nodes == 0:
            break
        if chained < WORTH * nodes:
            left = left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            if swapped:
                found = found.unionByName(_core(left))
                break
            swapped = True
            continue
        single = degree.where("n = 1").select(F.col("src").alias("node"), "next")
        chain = single.where(~_is_splitter(F.col("node"), level))
        inner = chain.select(F.col("node").alias("i_node"))
        start = chain.join(inner, F.col("next") == F.col("i_node"), "left").select("node", F.col("next").alias("cur"), F.array("next").alias("path"), F.col("i_node").isNotNull().alias("open"))
        walked, live = _walk(start)
        if not is_empty(live):
            found = found.unionByName(materialize(_loops(live)))
        stops = left.join(chain.select(F.col("node").alias("src")), "src", "left_anti")
        w = walked.select("node", F.col("cur").alias("stop"), F.concat(F.array("node"), F.slice("path", F.lit(1), F.size("path") - 1)).alias("way"))
        lost = live.select(F.col("node").alias("dst"))
        reduced = stops.join(lost, "dst", "left_anti").join(w, F.col("dst") == F.col("node"), "left").select("src", F.coalesce("stop", "dst").alias("dst"), F.coalesce("way", F.array().cast("array<string>")).alias("way"))
        reduced = materialize(reduced)
        ways.append(reduced)
        left, level, swapped = _trim(reduced.where("src <> dst").select("src", "dst").distinct()), level + 1, False
    for reduced in reversed(ways):
        found = materialize(found)
        selfs = reduced.where("src = dst").select(F.col("src").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        found = found.unionByName(selfs.select("node", F.col("node").alias("component")))
        a, b = found.select(F.col("node").alias("src"), F.col("component").alias("c_src")), found.select(F.col("node").alias("dst"), F.col("component").alias("c_dst"))
        inside = reduced.where(F.size("way") > 0).join(a, "src").join(b, "dst").where("c_src = c_dst")
        found = found.unionByName(inside.select(F.explode("way").alias("node"), F.col("c_src").alias("component")))
    found = materialize(found.distinct())
    found = found.unionByName(loops.join(found.select("node"), "node", "left_anti"))
    names = found.groupBy(F.col("component").alias("label")).agg(F.max("node").alias("greatest"))
    return found.join(names, F.col("component") == F.col("label")).select("node", F.col("greatest").alias("component"))


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` of an undirected graph: the least key of each component (large-star, small-star).

    Both star operations move links to smaller nodes and need about log(n) rounds. The least neighbours of nodes with
    very many links, at most HEAVY_SHARE of them, are joined by broadcast, so that no task gets a hub's links.
    """
    e = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).where("src is not null and dst is not null")
    nodes = materialize(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    cur = materialize(e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None

    def with_least(links: DataFrame, key: str, other: str) -> DataFrame:
        least = materialize(links.groupBy(key).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("k")))
        total = least.agg(F.sum("k")).first()[0] or 0
        line = max(HEAVY_LEAST, total // HEAVY_SHARE)
        hub, rest = least.where(F.col("k") > line).select(key, "m"), least.where(F.col("k") <= line).select(key, "m")
        at_hub = links.join(F.broadcast(hub), key)
        return links.join(F.broadcast(hub.select(key)), key, "left_anti").join(rest, key).unionByName(at_hub)

    while True:
        both = cur.select(F.col("u").alias("a"), F.col("v").alias("b")).union(cur.select("v", "u"))
        large = with_least(both, "a", "b").withColumn("m", F.least("m", "a")).where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        linked = with_least(large, "u", "v")
        small = linked.select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").union(linked.select(F.col("u").alias("x"), F.col("m").alias("y"))).select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()
        cur = materialize(small)
        was, mark = mark, cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    return nodes.join(cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
