"""Watching a folder of sources: every micro-batch updates the graph and then the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from codeloom.graph import PropertyGraph
from codeloom.operators.etl import extract, graph_tables, manifest, manifest_diff, scan

FILES = "path string, content string, modified timestamp, is_deleted boolean"
DEBOUNCE = "500 milliseconds"


def latest_files(batch: DataFrame) -> DataFrame:
    """The last event of each path within a batch."""
    k = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("is_deleted"), F.desc("content")))
    return batch.withColumn("k", k).where("k = 1").drop("k")


def incremental_update(g: PropertyGraph, events: DataFrame, old: DataFrame | None = None) -> PropertyGraph:
    """The graph after file events: nodes of changed and deleted files go, those of changed files come anew.

    Edges from unchanged files into a changed one stay if their target is there again. ``old`` is the manifest before;
    files whose hash is the same are left alone.
    """
    e = latest_files(events)
    live = e.where(~F.coalesce("is_deleted", F.lit(False)))
    if old is not None:
        new = manifest(live.select(F.col("path").alias("file_path"), "content"))
        touched = manifest_diff(old.join(e.select("path"), "path", "left_semi"), new).select("path")
        e, live = e.join(touched, "path", "left_semi"), live.join(touched, "path", "left_semi")
    nodes, edges = graph_tables(extract(scan(live)))
    paths = e.select(F.col("path").alias("file_path"))
    kept = g.nodes.join(paths, "file_path", "left_anti").select(g.nodes.columns)
    all_nodes = kept.unionByName(nodes, allowMissingColumns=True)
    gone = g.nodes.join(paths, "file_path", "left_semi").select("id")
    stale = g.edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select(g.edges.columns)
    back = all_nodes.select(F.col("id").alias("target_id")).unionByName(stale.select("target_id").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")).distinct()
    return PropertyGraph(all_nodes, stale.join(back, "target_id", "left_semi").select(g.edges.columns).unionByName(edges, allowMissingColumns=True), g.rel_types)


def apply_batch(write_graph: Callable[[PropertyGraph], None], write_manifest: Callable[[DataFrame], None], read: Callable[[], tuple[PropertyGraph, DataFrame | None]], after: Callable[[PropertyGraph], None] | None = None, progress: Callable[[str, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A handler for :func:`watch` that keeps the order in which a restart finds nothing lost.

    ``read`` gives the graph and the manifest as they were written last. The new graph is written first, then the
    manifest, then ``after`` runs (communities, dead code and the like, which a batch leaves out by default).
    ``progress`` hears of each step by name, with the batch's number.
    """
    say = progress or (lambda step, batch: None)

    def handle(batch: DataFrame, number: int) -> None:
        say("start", number)
        g, old = read()
        events = latest_files(batch)
        new = incremental_update(g, batch, old)
        write_graph(new)
        say("graph", number)
        fresh = manifest(events.where(~F.coalesce("is_deleted", F.lit(False))).select(F.col("path").alias("file_path"), "content"))
        write_manifest(fresh if old is None else old.join(events.select("path"), "path", "left_anti").select("path", "hash", "size").unionByName(fresh))
        say("manifest", number)
        if after is not None:
            after(new)
            say("after", number)

    return handle


class Progress(StreamingQueryListener):
    """Hands the progress of streaming queries on to a callable: ``(query id, batch, rows)``, and -1 rows at the end."""

    def __init__(self, tell: Callable[[str, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell(str(event.id), -1, 0)

    def onQueryProgress(self, event) -> None:
        self.tell(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.tell(str(event.id), -1, -1)


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """A stream of file events (JSON lines) handed on batch by batch; restarts go on after the last batch.

    ``handle(batch, batch_id)`` must write the graph before the manifest and give the same result for the same batch.
    """
    s = spark.readStream.schema(FILES).json(folder)
    return s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": DEBOUNCE})).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total``: event-time windows that close once the watermark has passed."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``user_id, start, n``: sessions of a user that end after a gap."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")
