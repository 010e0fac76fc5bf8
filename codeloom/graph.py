"""The property graph: two DataFrames, nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

#: The relationship types of the vocabulary.
REL_TYPES = frozenset(
    "CONTAINS CALLS INHERITS OVERRIDES IMPORTS USES DEFINES DECORATES IMPLEMENTS EXTENDS HAS_METHOD HAS_PROPERTY ACCESSES MEMBER_OF STEP_IN_PROCESS HANDLES_ROUTE FETCHES HANDLES_TOOL ENTRY_POINT_OF WRAPS RENDERS_VIEW BELONGS_TO_AREA MAPS_TO_ENTITY HAS_ACTION BINDS_MODEL ASSOCIATES_WITH HAS_FILTER USES_PARTIAL CONFIGURED_BY CALLS_ACTION INCLUDES_SCRIPT RENDERS_COMPONENT DEPENDS_ON CALLS_SERVICE BELONGS_TO MENTIONS HAS_COLUMN REFERENCES_TABLE USES_ENV_VAR REPRESENTED_BY HANDLED_BY".split()
)
#: The node labels of the vocabulary.
LABELS = frozenset(
    "Project Package Module Folder File Class Function Method Variable Interface Enum Decorator Import Type CodeElement Community Process Struct Macro Typedef Union Namespace Trait Impl TypeAlias Const Static Property Record Delegate Annotation Constructor Template Section Route Tool Library Controller ControllerAction ApiEndpoint View ViewModel DbEntity DbContext Area Filter WebConfig PartialView ScriptFile AjaxCall UiComponent Service Repository ExternalService Document DocChunk TodoMarker DbColumn EnvVar".split()
)
EDGE_COLUMNS = ["id", "source_id", "target_id", "type", "confidence", "reason", "step"]


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable labelled graph; every change returns a new one.

    ``nodes`` has at least ``id, label, name, file_path``; ``edges`` has ``id, source_id, target_id, type`` and may have
    ``confidence, reason, step``. Edges may dangle. ``rel_types`` is the vocabulary against which queries check types.
    """

    nodes: DataFrame
    edges: DataFrame
    rel_types: frozenset[str] = field(default=REL_TYPES)

    def label(self, name: str) -> DataFrame:
        """Nodes of one label; on label-partitioned Parquet the other labels are not read."""
        return self.nodes.where(F.col("label") == name)

    def file(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("file_path") == path)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def out_edges(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    def upsert_nodes(self, new: DataFrame) -> PropertyGraph:
        """Rows of ``new`` replace those of the same id; of several new rows the greatest counts."""
        latest = new.groupBy("id").agg(F.max(F.struct(*[c for c in new.columns if c != "id"])).alias("r")).select("id", "r.*")
        kept = self.nodes.join(latest.select("id"), "id", "left_anti")
        return replace(self, nodes=kept.unionByName(latest, allowMissingColumns=True))

    def upsert_edges(self, new: DataFrame) -> PropertyGraph:
        latest = new.groupBy("id").agg(F.max(F.struct(*[c for c in new.columns if c != "id"])).alias("r")).select("id", "r.*")
        return replace(self, edges=self.edges.join(latest.select("id"), "id", "left_anti").unionByName(latest, allowMissingColumns=True))

    def remove_nodes(self, ids: DataFrame) -> PropertyGraph:
        """Without the nodes of ``ids`` (column ``id``) and without their edges."""
        gone = ids.select("id").distinct()
        e = self.edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        return replace(self, nodes=self.nodes.join(gone, "id", "left_anti"), edges=e.select(self.edges.columns))

    def remove_files(self, paths: DataFrame) -> PropertyGraph:
        """Without the nodes of the files in ``paths`` (column ``file_path``)."""
        return self.remove_nodes(self.nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id"))

    def remove_label(self, name: str) -> PropertyGraph:
        return self.remove_nodes(self.label(name).select("id"))


def code_graph(spark: SparkSession, folder: str, until: str | None = None) -> PropertyGraph:
    """The graph of the tables nodes and edges as it is now, or was at ``until``: of each node its latest version,
    unless that is a tombstone; of each edge one row, without rows that lack an end.

    The label is the first part of a node's id and the type of an edge does not change, so both are keys of the
    aggregates: a condition on them is answered by the Parquet scans, and only what it leaves is shuffled.
    """
    raw = table(spark, folder, "nodes")
    raw = raw.where(F.col("indexed_at") <= F.to_timestamp(F.lit(until))) if until else raw
    cols = [c for c in raw.columns if c not in ("id", "label", "indexed_at", "is_deleted")]
    # of versions of one instant a live one counts, then the greatest row, so that the choice does not depend on order
    order = F.struct("indexed_at", ~F.coalesce("is_deleted", F.lit(False)), *[F.col(c) for c in cols])
    latest = raw.where("id is not null").groupBy("id", "label").agg(F.max_by(F.struct(*cols, F.col("is_deleted")), order).alias("r"))
    nodes = latest.where(~F.coalesce("r.is_deleted", F.lit(False))).select("id", "label", *[f"r.{c}" for c in cols])
    e = table(spark, folder, "edges").where("source_id is not null and target_id is not null")
    e = e.where(F.col("recorded_at") <= F.to_timestamp(F.lit(until))) if until else e
    edges = e.groupBy("id", F.col("rel_type").alias("type")).agg(F.max(F.struct("source_id", "target_id", "confidence", "reason", "step")).alias("r"))
    return PropertyGraph(nodes, edges.select("id", "r.source_id", "r.target_id", "type", "r.confidence", "r.reason", "r.step"))


def star_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The order tables as a graph: regions, nations, customers, suppliers, parts and orders."""
    t = {n: table(spark, folder, n) for n in "region nation customer supplier part orders lineitem".split()}

    def nodes(df, label, key, name, path, complexity=None):
        return df.select(
            F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), path.alias("file_path"),
            (complexity if complexity is not None else F.lit(None)).cast("long").alias("complexity"),
        )

    n = nodes(t["region"], "Region", "r_regionkey", "r_name", F.lit("region/all"))
    n = n.unionByName(nodes(t["nation"], "Nation", "n_nationkey", "n_name", F.concat(F.lit("nation/"), F.col("n_regionkey").cast("string"))))
    n = n.unionByName(nodes(t["customer"], "Customer", "c_custkey", "c_name", F.concat(F.lit("customer/"), F.col("c_mktsegment"))))
    n = n.unionByName(nodes(t["supplier"], "Supplier", "s_suppkey", "s_name", F.concat(F.lit("supplier/"), F.col("s_nationkey").cast("string"))))
    n = n.unionByName(nodes(t["part"], "Part", "p_partkey", "p_name", F.concat(F.lit("part/"), F.col("p_brand")), F.col("p_size")))
    n = n.unionByName(nodes(t["orders"], "Order", "o_orderkey", "o_orderkey", F.concat(F.lit("order/"), F.col("o_orderstatus"))))

    def edges(df, a, a_key, kind, b, b_key):
        s, d = F.concat(F.lit(f"{a}:"), F.col(a_key).cast("string")), F.concat(F.lit(f"{b}:"), F.col(b_key).cast("string"))
        return df.select(F.concat_ws("|", s, F.lit(kind), d).alias("id"), s.alias("source_id"), d.alias("target_id"), F.lit(kind).alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("step"))

    e = edges(t["nation"], "Nation", "n_nationkey", "BELONGS_TO", "Region", "n_regionkey")
    e = e.unionByName(edges(t["customer"], "Customer", "c_custkey", "MEMBER_OF", "Nation", "c_nationkey"))
    e = e.unionByName(edges(t["supplier"], "Supplier", "s_suppkey", "MEMBER_OF", "Nation", "s_nationkey"))
    e = e.unionByName(edges(t["orders"], "Order", "o_orderkey", "BELONGS_TO", "Customer", "o_custkey"))
    e = e.unionByName(edges(t["lineitem"].select("l_orderkey", "l_partkey").distinct(), "Order", "l_orderkey", "CONTAINS", "Part", "l_partkey"))
    e = e.unionByName(edges(t["lineitem"].select("l_partkey", "l_suppkey").distinct(), "Part", "l_partkey", "DEPENDS_ON", "Supplier", "l_suppkey"))
    return PropertyGraph(n, e)
