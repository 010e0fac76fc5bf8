"""Graph algorithms: cycles, clone clusters, levels, communities, execution flows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.kernels import cycle_severity, jaccard
from codeloom.graph import PropertyGraph
from codeloom.operators.components import connected, strongly_connected
from codeloom.session import is_empty
from codeloom.session import settle as materialize

SHINGLE, CLONE_LEAST, CLONE_SIMILARITY = 30, 30, 0.9
#: Beyond LOUVAIN_LARGE nodes fewer passes, a finer resolution and only sure edges count, as the feature is defined.
LOUVAIN_PASSES, LOUVAIN_LARGE, LARGE_PASSES, LARGE_RESOLUTION, LARGE_CONFIDENCE = 10, 10_000, 3, 2.0, 0.5
LOUVAIN_LABELS = ("Function", "Method", "Class", "Interface", "Struct", "Constructor", "Enum", "Trait")
LOUVAIN_TYPES = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")
FLOW_DEPTH, FLOW_BRANCH, FLOW_LEAST, FLOW_TRACES, FLOW_SEEDS, FLOW_KEPT = 10, 4, 3, 4096, 200, 75
#: Parts of names that entry points have.
ENTRY_PARTS = ("main", "init", "bootstrap", "start", "run", "setup", "configure", "register", "mount", "listen", "serve", "execute", "launch", "handle", "process")


def cycles(g: PropertyGraph, scope: str = "imports") -> DataFrame:
    """``component, length, severity, members`` of file import cycles or call cycles, longest first."""
    labels, kind = (("File",), "IMPORTS") if scope == "imports" else (("Method", "Function", "Constructor"), "CALLS")
    ids = g.nodes.where(F.col("label").isin(*labels)).select("id")
    e = g.out_edges(kind).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    c = strongly_connected(e).groupBy("component").agg(F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_list("node")).alias("members"))
    return c.select(F.array_min("members").alias("component"), "length", cycle_severity(F.col("length")).alias("severity"), "members")


def short_cycles(g: PropertyGraph, most: int = 20, depth: int = 100) -> DataFrame:
    """``length, members``: simple cycles of file imports and dependencies, one of each set of files, shortest first.

    Ways start at the least file of a cycle and stay within its component; a round adds one file, and the search ends
    once ``most`` cycles are known, nothing is left to follow or the depth is reached. Which cycles are shown is part
    of the report's definition; all files on cycles are in :func:`cycles`.
    """
    ids = g.label("File").select("id")
    e = g.out_edges("IMPORTS", "DEPENDS_ON").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()
    e = materialize(e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    c = materialize(strongly_connected(e))
    a, b = c.select(F.col("node").alias("src"), F.col("component").alias("ca")), c.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    e = materialize(e.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
    front, found = e.select(F.col("src").alias("first"), F.array("src").alias("path")).distinct(), None
    for k in range(1, depth + 1):
        step = front.join(e, F.element_at("path", -1) == F.col("src"))
        closed = materialize(step.where("dst = first").select(F.lit(k).alias("length"), F.array_sort("path").alias("members")).distinct())
        found = closed if found is None else materialize(found.unionByName(closed).orderBy("length", "members").limit(most))
        if found.count() >= most:
            break
        front = materialize(step.where(F.col("dst") > F.col("first")).where(~F.array_contains("path", F.col("dst"))).select("first", F.concat("path", F.array("dst")).alias("path")))
        if is_empty(front):
            break
    return found.orderBy("length", "members").limit(most)


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, level``: files without imports first, each level imports earlier ones only; files on or behind a cycle
    share one last level. ``edges`` are (src, dst): src imports dst."""
    e = materialize(edges.where("src <> dst").distinct())
    left = materialize(nodes.select("id").distinct())
    e = e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")
    done, k = None, 0
    while not is_empty(left):
        waiting = e.select(F.col("src").alias("id")).distinct()
        free = materialize(left.join(waiting, "id", "left_anti"))
        last = is_empty(free)
        level = (left if last else free).withColumn("level", F.lit(k))
        done = level if done is None else done.unionByName(level)
        if last:
            break
        left = materialize(left.join(free, "id", "left_anti"))
        e = materialize(e.join(free.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        k += 1
    return done if done is not None else nodes.select("id").withColumn("level", F.lit(0)).limit(0)


#: Words that stay themselves in a clone comparison.
_KEEP = "if else for while do switch case default break continue return function class struct enum interface new this super null true false try catch finally throw import export const let var static public private protected async await yield in of is as def fn func pub impl match use mod type void int float double bool string char".split()


def clone_tokens(text: str) -> list[str]:
    """Tokens of a source text: comments dropped, strings and numbers LIT, other names ID, punctuation as it is."""
    import re

    text = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", " ", text)
    out = []
    for m in re.finditer(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|[A-Za-z_$][\w$]*|\d[\w.]*|\S", text):
        t = m.group()
        out.append("LIT" if t[0] in "\"'`" or t[0].isdigit() else t if not (t[0].isalpha() or t[0] in "_$") or t in _KEEP else "ID")
    return out


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from hashlib import blake2b

    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["text"]):
            t = clone_tokens(text or "")
            if len(t) < CLONE_LEAST:
                continue
            hashes = {int.from_bytes(blake2b(" ".join(t[k : k + SHINGLE]).encode(), digest_size=8).digest(), "big", signed=True) for k in range(len(t) - SHINGLE + 1)}
            rows.append((i, sorted(set(t)), sorted(hashes)))
        yield pd.DataFrame(rows, columns=["id", "words", "hashes"])


def _similar_sets(sets: DataFrame) -> DataFrame:
    """``a, b`` of the pairs of distinct token sets (``sig, words``) whose Jaccard is at least CLONE_SIMILARITY.

    Two such sets share one of their rarest tokens: all but the first n - ceil(CLONE_SIMILARITY n) + 1 of a set of n
    cannot hold the whole overlap. Sets meet through those tokens alone, and no pair that reaches the limit is missed.
    """
    w = sets.select("sig", F.explode("words").alias("word"))
    rare = w.join(w.groupBy("word").agg(F.count(F.lit(1)).alias("k")), "word").groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("ws"))
    keep = F.size("ws") - F.ceil(F.round(F.lit(CLONE_SIMILARITY) * F.size("ws"), 6)).cast("int") + 1
    p = rare.select("sig", F.explode(F.slice("ws", F.lit(1), keep)).alias("x")).select("sig", F.col("x.word").alias("word"))
    near = p.select(F.col("sig").alias("a"), "word").join(p.select(F.col("sig").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    j = near.join(sets.select(F.col("sig").alias("a"), F.col("words").alias("wa")), "a").join(sets.select(F.col("sig").alias("b"), F.col("words").alias("wb")), "b")
    return j.where(jaccard(F.col("wa"), F.col("wb")) >= CLONE_SIMILARITY).select("a", "b")


def clone_clusters(texts: DataFrame) -> DataFrame:
    """``id, cluster, size, similarity`` of near-identical texts (``id, text``).

    Two texts are linked if they share a window of SHINGLE tokens and the Jaccard of their token sets is at least
    CLONE_SIMILARITY; clusters are the components of these links. Texts of equal windows and tokens count as one. In a
    window all texts of one token set are linked through the least of them, and of two sets that are similar the least
    ones are linked, which joins the same texts as all pairs would. A cluster's similarity is the mean Jaccard of its
    members' token sets with those of its least member; it is reported and rejects nothing. Texts of fewer than
    CLONE_LEAST tokens and texts without a partner have no row.
    """
    s = texts.select("id", "text").mapInPandas(_shingles, f"id {dict(texts.dtypes)['id']}, words array<string>, hashes array<long>")
    s = materialize(s.select(F.col("id").cast("string").alias("id"), "words", "hashes", F.xxhash64("words").alias("sig"), F.xxhash64("hashes").alias("whole")))
    one = materialize(s.groupBy("sig", "whole").agg(F.min("id").alias("lead"), F.first("hashes").alias("hashes")))
    sets = materialize(s.groupBy("sig").agg(F.first("words").alias("words")))
    h = one.select("lead", "sig", F.explode("hashes").alias("h"))
    shared = h.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    h = materialize(h.join(shared, "h"))
    first = materialize(h.groupBy("h", "sig").agg(F.min("lead").alias("m")))
    same = h.join(first, ["h", "sig"]).where("lead <> m").select(F.col("lead").alias("src"), F.col("m").alias("dst"))
    pairs = first.join(_similar_sets(sets), F.col("sig") == F.col("a")).select("h", F.col("m").alias("src"), F.col("b").alias("sig"))
    across = pairs.join(first, ["h", "sig"]).select("src", F.col("m").alias("dst"))
    c = connected(same.unionByName(across).distinct())
    members = s.select("id", "sig", "whole").join(one.select("sig", "whole", "lead"), ["sig", "whole"]).join(c.withColumnRenamed("node", "lead"), "lead", "left")
    members = materialize(members.select("id", "sig", F.coalesce("component", "lead").alias("cluster")))
    lead = members.where("id = cluster").join(sets, "sig").select("cluster", F.col("words").alias("lead_words"))
    kinds = members.groupBy("cluster", "sig").agg(F.count(F.lit(1)).alias("k")).join(sets, "sig").join(lead, "cluster")
    # the least member itself is left out of the mean; its Jaccard is 1
    size = kinds.groupBy("cluster").agg(F.sum("k").alias("size"), F.sum(F.col("k") * jaccard(F.col("words"), F.col("lead_words"))).alias("total")).where("size > 1")
    return members.join(size, "cluster").select("id", "cluster", "size", ((F.col("total") - 1) / (F.col("size") - 1)).alias("similarity"))


def communities(g: PropertyGraph, passes: int | None = None, resolution: float | None = None) -> DataFrame:
    """``id, community``: one level of modularity moves, all nodes of one half at a time.

    Nodes move to the neighbouring community with the greatest modularity gain, ties to the least key; in every pass
    first the nodes of even hash move and then the others, so that two nodes do not swap for ever. A pass that moves
    no node is the last, as is pass number ``passes``. Communities of one node are dropped. Weights count distinct neighbours; a hub meets its neighbours in a grouped sum.
    """
    ids = materialize(g.nodes.where(F.col("label").isin(*LOUVAIN_LABELS)).select("id"))
    large = ids.count() > LOUVAIN_LARGE
    passes = passes or (LARGE_PASSES if large else LOUVAIN_PASSES)
    resolution = resolution or (LARGE_RESOLUTION if large else 1.0)
    links = g.out_edges(*LOUVAIN_TYPES)
    if large and "confidence" in g.edges.columns:
        links = links.where(F.coalesce("confidence", F.lit(1.0)) >= LARGE_CONFIDENCE)
    e = links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a <> b")
    e = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    deg = materialize(e.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("deg")))
    m2 = deg.agg(F.sum("deg")).first()[0] or 1.0
    c = materialize(deg.select(F.col("a").alias("id"), "deg", F.col("a").alias("community")))
    moved = -1
    for k in range(2 * passes):
        tot = c.groupBy("community").agg(F.sum("deg").alias("tot"))
        to = e.join(c.select(F.col("id").alias("b"), "community"), "b").groupBy("a", "community").agg(F.count(F.lit(1)).alias("w"))
        me = c.select(F.col("id").alias("a"), F.col("deg"), F.col("community").alias("mine"))
        g_ = to.join(me, "a").join(tot, "community")
        rest = F.col("tot") - F.when(F.col("community") == F.col("mine"), F.col("deg")).otherwise(0.0)
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("deg") * rest / m2, 9)
        best = g_.groupBy("a").agg(F.min(F.struct((-gain).alias("g"), "community")).alias("t"), F.max(F.when(F.col("community") == F.col("mine"), gain)).alias("stay"))
        j = c.join(best.select(F.col("a").alias("id"), F.col("t.community").alias("to"), (-F.col("t.g")).alias("gain"), "stay"), "id", "left")
        alone = F.round(-F.lit(resolution) * F.col("deg") * 0.0 / m2, 9)
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == k % 2
        moves = turn & F.col("to").isNotNull() & (F.col("to") != F.col("community")) & (F.col("gain") > F.coalesce("stay", alone) + 1e-9)
        new = materialize(j.select("id", "deg", F.when(moves, F.col("to")).otherwise(F.col("community")).alias("community"), F.coalesce(moves, F.lit(False)).alias("moved")))
        c = new.drop("moved")
        moved, last = new.where("moved").count(), moved
        if moved == 0 and last == 0:
            break
    big = c.groupBy("community").count().where("count > 1").select("community")
    return c.join(big, "community", "left_semi").select("id", "community")


def community_names(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """``community, name, n_members``: the last folder that most members share; ties go to the least."""
    folder = F.element_at(F.array_union(F.array(F.lit("root")), F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))), -1)
    k = membership.join(nodes.select("id", "file_path"), "id").groupBy("community", folder.alias("name")).agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy("community").agg(F.min(F.struct((-F.col("k")).alias("k"), "name")).alias("t"), F.sum("k").alias("n_members")).select("community", F.col("t.name").alias("name"), "n_members")


def lifted_calls(g: PropertyGraph) -> DataFrame:
    """``a, b`` calls between callables; a call from a file counts for every callable the file defines."""
    ids = g.nodes.where(F.col("label").isin("Function", "Method", "Constructor")).select("id")
    calls = g.out_edges("CALLS").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    defs = g.out_edges("DEFINES").select(F.col("source_id").alias("f"), F.col("target_id").alias("d")).join(ids.withColumnRenamed("id", "d"), "d", "left_semi")
    lifted = calls.join(defs, F.col("a") == F.col("f")).select(F.col("d").alias("a"), "b")
    all_ = calls.unionByName(lifted).where("a <> b")
    return all_.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").distinct()


def entry_points(g: PropertyGraph, limit: int = FLOW_SEEDS) -> DataFrame:
    """``id, score`` of likely entry points: exported, uncalled, calling much, named like one."""
    calls = lifted_calls(g)
    out, back = calls.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_out")), calls.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    name = F.lower("name").rlike("|".join(ENTRY_PARTS))
    score = F.when(F.col("is_exported"), 3.0).otherwise(0.0) + F.when(F.coalesce("n_in", F.lit(0)) == 0, 5.0).otherwise(2.0 / F.col("n_in")) + F.least(F.col("n_out").cast("double"), F.lit(5.0)) + F.when(name, 2.0).otherwise(0.0)
    if "entry_point_score" in g.nodes.columns:
        score = score + F.coalesce("entry_point_score", F.lit(0.0))
    return g.nodes.join(out, "id").join(back, "id", "left").select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def trace_flows(g: PropertyGraph, seeds: DataFrame, depth: int = FLOW_DEPTH) -> DataFrame:
    """``seed, path`` of simple call paths from each seed along the first FLOW_BRANCH callees, at least FLOW_LEAST long.

    A path ends where no callee is new or the depth is reached; FLOW_TRACES paths a seed, in order, are kept, which is
    part of the result's definition.
    """
    k = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    calls = materialize(lifted_calls(g).withColumn("k", k).where(F.col("k") <= FLOW_BRANCH).select("a", "b"))
    front = materialize(seeds.select(F.col("id").alias("seed"), F.array("id").alias("path")))
    done = None
    for _ in range(depth):
        nxt = front.join(calls, F.element_at("path", -1) == F.col("a")).where(~F.array_contains("path", F.col("b")))
        grown = nxt.select("seed", F.concat("path", F.array("b")).alias("path"), F.col("path").alias("was"))
        r = F.row_number().over(Window.partitionBy("seed").orderBy("path"))
        grown = materialize(grown.withColumn("r", r).where(F.col("r") <= FLOW_TRACES).drop("r"))
        ended = front.join(grown.select("seed", F.col("was").alias("path")).distinct(), ["seed", "path"], "left_anti").where(F.size("path") >= FLOW_LEAST)
        done = ended if done is None else done.unionByName(ended)
        front = grown.select("seed", "path")
        if is_empty(front):
            break
    return done.unionByName(front.where(F.size("path") >= FLOW_LEAST))


def _keep_flows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Longest first; one a pair of ends; none whose steps a kept one has all."""
    rows = sorted((tuple(p) for p in pdf["path"]), key=lambda p: (-len(p), p))
    kept, ends = [], set()
    for p in rows:
        if (p[0], p[-1]) in ends or any(set(p) <= s for s, _ in kept):
            continue
        ends.add((p[0], p[-1]))
        kept.append((set(p), p))
        if len(kept) == FLOW_KEPT:
            break
    return pd.DataFrame({"process_id": [f"Process:{i + 1}" for i in range(len(kept))], "path": [list(p) for _, p in kept]})


def processes(g: PropertyGraph, membership: DataFrame | None = None) -> DataFrame:
    """``process_id, name, k, id, kind``: execution flows and their steps.

    At most FLOW_SEEDS seeds with FLOW_TRACES paths each come in, so the greedy choice is one bounded task.
    """
    flows = trace_flows(g, entry_points(g)).select("path").distinct().withColumn("one", F.lit(1))
    kept = materialize(flows.groupBy("one").applyInPandas(_keep_flows, "process_id string, path array<string>"))
    names = g.nodes.select("id", F.col("name").alias("step_name"))
    s = kept.select("process_id", F.posexplode("path").alias("k", "id"), F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"))
    s = s.join(names, "id").join(names.select(F.col("id").alias("first"), F.col("step_name").alias("a")), "first").join(names.select(F.col("id").alias("last"), F.col("step_name").alias("b")), "last")
    s = s.select("process_id", F.concat_ws(" -> ", "a", "b").alias("name"), (F.col("k") + 1).alias("k"), "id")
    if membership is None:
        return s.withColumn("kind", F.lit("intra_community"))
    n = s.join(membership, "id", "left").groupBy("process_id").agg(F.countDistinct("community").alias("n"))
    return s.join(n, "process_id").select("process_id", "name", "k", "id", F.when(F.col("n") > 1, "cross_community").otherwise("intra_community").alias("kind"))
