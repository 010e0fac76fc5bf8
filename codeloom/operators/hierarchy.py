"""Parent-child links to full hierarchies: list ranking with hash splitters.

A table of (node, parent) links, at most one parent a node, is a forest with possible loops. Pointer doubling over
all nodes would shuffle every row once for each power of two of the depth. Here a fixed share of the nodes, chosen by
a hash of their key and therefore the same in every run, are *splitters*. Every node walks only to its next splitter
(short walks, doubled, the finished ones drop out); the splitters alone form the reduced pointer graph, which is
solved over 1/k of the rows; exact roots, depths and paths are then expanded with one join.

Nodes with very many children are splitters too, so that their children need no walk, and their results are joined by
broadcast: there are at most ``HEAVY_SHARE`` of them, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import settle as materialize

SPLITTER_EVERY = 8
HEAVY_SHARE = 1000
HEAVY_LEAST = 5000


def _is_hash_splitter(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SPLITTER_EVERY)) == 0


def _double(state: DataFrame, jumps: DataFrame, with_paths: bool) -> DataFrame:
    """One round: the open rows of ``state`` take over where their target stands in ``jumps``."""
    j = jumps.select(F.col("node").alias("j_node"), F.col("cur").alias("j_cur"), F.col("dist").alias("j_dist"), F.col("status").alias("j_status"), *([F.col("path").alias("j_path")] if with_paths else []))
    found = F.col("j_node").isNotNull()
    joined = state.join(j, F.col("cur") == F.col("j_node"), "left")
    cols = [
        F.col("node"),
        F.when(found & (F.col("j_status") != "loop"), F.col("j_cur")).otherwise(F.col("cur")).alias("cur"),
        (F.col("dist") + F.when(found, F.col("j_dist")).otherwise(F.lit(0))).cast("long").alias("dist"),
        F.when(~found, F.lit("end")).otherwise(F.col("j_status")).alias("status"),
    ]
    if with_paths:
        cols.append(F.when(found, F.concat("path", "j_path")).otherwise(F.col("path")).alias("path"))
    return joined.select(*cols)


def _walk(start: DataFrame, with_paths: bool) -> DataFrame:
    """Double until nothing is open, or until a round ends no walk. Of the open rows on a walk that ends, the last one
    points past all open rows and ends in the next round; so rows that are left then are on a loop or below one."""
    state, before = materialize(start), None
    while True:
        still = state.where(F.col("status") == "open")
        n = still.count()
        if n == 0:
            return state
        if n == before:
            return state.withColumn("status", F.when(F.col("status") == "open", "loop").otherwise(F.col("status")))
        before = n
        state = materialize(state.where(F.col("status") != "open").unionByName(_double(still, state, with_paths)))


def resolve_hierarchy(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root, depth and, if asked for, the full path of every node.

    ``links`` has the columns ``node`` and ``parent`` (nullable strings); further columns are ignored. Returns
    ``node, root, depth[, path]``: depth 0 and itself as root for a node without parent; a parent that is no node of
    its own ends the chain and is the root. ``path`` runs from the root to the node. Nodes on a loop or below one have
    root null, depth -1 and path null. Rows with a null node are left out; repeated rows count once; of several
    different parents (which a forest does not have) the least one counts. An empty table gives an empty result.
    """
    rows = links.select(F.col("node").cast("string"), F.col("parent").cast("string")).where(F.col("node").isNotNull())
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"))
    nodes = materialize(nodes)
    total = nodes.count()
    limit = max(HEAVY_LEAST, total // HEAVY_SHARE)
    heavy = materialize(nodes.where(F.col("parent").isNotNull()).groupBy("parent").count().where(F.col("count") > limit).select(F.col("parent").alias("h_node")))
    # at most HEAVY_SHARE rows, since each stands for more than total / HEAVY_SHARE children
    pointers = nodes.where(F.col("parent").isNotNull()).join(F.broadcast(heavy), F.col("parent") == F.col("h_node"), "left")
    start = pointers.select(
        "node",
        F.col("parent").alias("cur"),
        F.lit(1).cast("long").alias("dist"),
        F.when(F.col("h_node").isNotNull() | _is_hash_splitter(F.col("parent")), F.lit("split")).otherwise(F.lit("open")).alias("status"),
        *([F.array("parent").alias("path")] if with_paths else []),
    )
    walked = _walk(start, with_paths)

    # the reduced graph: splitters that have a parent; "split" means that the walk goes on from there
    mine = walked.join(F.broadcast(heavy), F.col("node") == F.col("h_node"), "left")
    reduced = mine.where(F.col("h_node").isNotNull() | _is_hash_splitter(F.col("node"))).drop("h_node")
    solved = _walk(reduced.withColumn("status", F.when(F.col("status") == "split", "open").otherwise(F.col("status"))), with_paths)

    # expansion: rows whose walk stopped at a splitter take its result
    waiting = walked.where(F.col("status") == "split").join(F.broadcast(heavy), F.col("cur") == F.col("h_node"), "left")
    hot = solved.join(F.broadcast(heavy), F.col("node") == F.col("h_node"), "left_semi")
    expanded = _double(waiting.where(F.col("h_node").isNull()).drop("h_node"), solved, with_paths).unionByName(
        _double(waiting.where(F.col("h_node").isNotNull()).drop("h_node"), F.broadcast(hot), with_paths)
    )
    done = walked.where(F.col("status") != "split").unionByName(expanded)
    loop = F.col("status") == "loop"
    cols = [F.col("node"), F.when(~loop, F.col("cur")).alias("root"), F.when(loop, F.lit(-1)).otherwise(F.col("dist")).cast("int").alias("depth")]
    roots = [F.col("node"), F.col("node").alias("root"), F.lit(0).alias("depth")]
    if with_paths:
        cols.append(F.when(~loop, F.reverse(F.concat(F.array("node"), F.col("path")))).alias("path"))
        roots.append(F.array("node").alias("path"))
    return done.select(*cols).unionByName(nodes.where(F.col("parent").isNull()).select(*roots))


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a result of :func:`resolve_hierarchy` with paths.

    One row a step of a path, which is the size of the answer; for nodes of a loop or below one see
    :func:`loop_descendants`.
    """
    steps = resolved.where(F.col("path").isNotNull()).select(F.col("node").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor"))
    return steps.where(F.col("pos") < F.col("n") - 1).select("ancestor", "descendant", (F.col("n") - 1 - F.col("pos")).cast("int").alias("distance"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """Number of descendants of every node that has any; counted before the shuffle, so a huge family is no hot task."""
    return descendants(resolved).groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


def loop_descendants(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of the nodes on a loop or below one, which have no path.

    A node's ancestors are the nodes that its parent links meet until one comes again, without the node itself, each at
    its least distance. Distances double in every round, until a round meets no new pair; every such node then
    has met all of its ancestors, as new ones follow each other without a gap.
    """
    caught = resolved.where(F.col("depth") == -1).select("node")
    rows = links.select(F.col("node").cast("string"), F.col("parent").cast("string")).where(F.col("parent").isNotNull())
    step = materialize(rows.groupBy("node").agg(F.min("parent").alias("up")).join(caught, "node", "left_semi"))
    pairs = materialize(step.where("node <> up").select(F.col("up").alias("ancestor"), F.col("node").alias("descendant"), F.lit(1).alias("distance")))
    n, reach = pairs.count(), 1
    while n:
        on = step.select(F.col("node").alias("j_node"), F.col("up").alias("j_up"))  # every caught node's ancestor at ``reach``
        far = pairs.select("descendant", "ancestor", "distance").join(on, F.col("descendant") == F.col("j_up"))
        more = far.where("ancestor <> j_node").select("ancestor", F.col("j_node").alias("descendant"), (F.col("distance") + reach).alias("distance"))
        level = step.where("node <> up").select(F.col("up").alias("ancestor"), F.col("node").alias("descendant"), F.lit(reach).alias("distance"))
        pairs = materialize(pairs.unionByName(level).unionByName(more).groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance")))
        step = materialize(step.join(on, F.col("up") == F.col("j_node")).select("node", F.col("j_up").alias("up")))
        was, n, reach = n, pairs.count(), 2 * reach
        if n == was:
            break
    return pairs
