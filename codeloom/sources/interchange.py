"""Readers and writers of the graph's interchange forms."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.graph import REL_TYPES, PropertyGraph

#: The mark of the embedding file format, and the greatest lengths of contents in CSV.
MAGIC = b"GNEMB001"
CONTENT_MOST = {"File": 10_000, "default": 5_000}


def write_graph(g: PropertyGraph, path: str) -> None:
    """Parquet, nodes partitioned by label and edges by type, so that scans of one label read one folder."""
    g.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def read_snapshot(spark: SparkSession, path: str) -> PropertyGraph:
    """One JSON document with ``nodes`` and ``relationships`` keyed by id, properties in camel case."""
    doc = spark.read.text(path, wholetext=True)
    node = "map<string, struct<id: string, label: string, properties: map<string, string>>>"
    rel = "map<string, struct<id: string, sourceId: string, targetId: string, type: string, confidence: double, reason: string, step: int>>"
    j = doc.select(F.from_json("value", f"struct<nodes: {node}, relationships: {rel}>").alias("d"))
    n = j.select(F.explode(F.map_values("d.nodes")).alias("n")).select("n.id", "n.label", "n.properties")
    keys = [r[0] for r in n.select(F.explode(F.map_keys("properties"))).distinct().collect()]  # property names: at most the fields of the schema
    nodes = n.select("id", "label", *[F.col("properties")[k].alias(_snake(k)) for k in sorted(keys)])
    e = j.select(F.explode(F.map_values("d.relationships")).alias("r")).select("r.id", F.col("r.sourceId").alias("source_id"), F.col("r.targetId").alias("target_id"), "r.type", "r.confidence", "r.reason", "r.step")
    for c in ("start_line", "end_line", "complexity", "parameter_count", "trace_call_count"):
        if c in nodes.columns:
            nodes = nodes.withColumn(c, F.col(c).cast("long"))
    for c in ("is_exported", "is_traced", "is_dead_candidate"):
        if c in nodes.columns:
            nodes = nodes.withColumn(c, F.col(c).cast("boolean"))
    return PropertyGraph(nodes, e)


def snapshot_lines(g: PropertyGraph) -> DataFrame:
    """``part, k, value``: the lines of one JSON document with ``nodes`` and ``relationships`` keyed by id.

    Every record is one line, so that a reader may take them line by line; the commas stand before all but the first.
    """
    camel = lambda c: c.split("_")[0] + "".join(x.capitalize() for x in c.split("_")[1:])
    props = F.struct(*[F.col(c).alias(camel(c)) for c in g.nodes.columns if c not in ("id", "label")])
    n = g.nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.to_json(F.struct("id", "label", props.alias("properties"))).alias("json"))
    get = lambda c: F.col(c) if c in g.edges.columns else F.lit(None)
    e = g.edges.select(F.lit(3).alias("part"), F.col("id").alias("k"), F.to_json(F.struct("id", F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId"), "type", get("confidence").alias("confidence"), get("reason").alias("reason"), get("step").alias("step"))).alias("json"))
    rows = n.unionByName(e)
    first = rows.groupBy("part").agg(F.min("k").alias("least"))  # two rows
    rows = rows.join(F.broadcast(first), "part").select("part", "k", F.concat(F.when(F.col("k") == F.col("least"), "").otherwise(","), F.to_json(F.struct(F.col("k").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("k").alias("x")))) - 6), F.lit(":"), F.col("json")).alias("value"))
    marks = g.nodes.sparkSession.createDataFrame([(0, "", '{"nodes":{'), (2, "", '},"relationships":{'), (4, "", "}}")], "part int, k string, value string")
    return marks.unionByName(rows)


def write_snapshot(g: PropertyGraph, path: str) -> None:
    """The snapshot as text; a document is one file by its form, so one task writes the sorted lines."""
    snapshot_lines(g).repartitionByRange("part", "k").sortWithinPartitions("part", "k").orderBy("part", "k").coalesce(1).select("value").write.mode("overwrite").text(path)


def node_rows(nodes: DataFrame) -> DataFrame:
    """Columns of the CSV form: control characters dropped, long contents cut, binary ones emptied."""
    cols = nodes.columns
    get = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    content = F.coalesce(get("content").cast("string"), F.lit(""))
    bad = F.length(content) - F.length(F.regexp_replace(content, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    clean = F.regexp_replace(content, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    most = F.when(F.col("label") == "File", CONTENT_MOST["File"]).otherwise(CONTENT_MOST["default"])
    kept = F.when(bad > 0.1 * F.length(content), "[binary content]").otherwise(F.substring(clean, F.lit(1), most))
    return nodes.select("label", "id", "name", F.col("file_path").alias("filePath"), kept.alias("content"), get("start_line").alias("startLine"), get("end_line").alias("endLine"), get("language").alias("language"), get("is_exported").alias("isExported"))


def write_csv(g: PropertyGraph, path: str) -> None:
    """One folder of CSV a label, and the edges with four decimals of confidence."""
    node_rows(g.nodes).write.mode("overwrite").partitionBy("label").option("header", True).option("escape", '"').csv(f"{path}/nodes")
    edge_rows(g.edges).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/edges")


def edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias("from"), F.col("target_id").alias("to"), "type", F.format_string("%.4f", F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"), "step")


def read_csv(spark: SparkSession, path: str) -> PropertyGraph:
    n = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/nodes", schema="id string, name string, filePath string, content string, startLine long, endLine long, language string, isExported boolean, label string")
    e = spark.read.option("header", True).option("escape", '"').csv(f"{path}/edges", schema="`from` string, `to` string, type string, confidence double, reason string, step int")
    nodes = n.select("id", "label", "name", F.col("filePath").alias("file_path"), "content", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), "language", F.col("isExported").alias("is_exported"))
    return PropertyGraph(nodes, e.select(F.concat_ws("|", "from", "type", "to").alias("id"), F.col("from").alias("source_id"), F.col("to").alias("target_id"), "type", "confidence", "reason", "step"), REL_TYPES)


def dot_lines(g: PropertyGraph) -> DataFrame:
    """Lines of a DOT graph, with their order."""
    q = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    n = g.nodes.select(F.lit(1).alias("part"), F.format_string('  "%s" [label="%s: %s"];', q(F.col("id")), F.col("label"), q(F.col("name"))).alias("value"))
    e = g.edges.select(F.lit(2).alias("part"), F.format_string('  "%s" -> "%s" [label="%s"];', q(F.col("source_id")), q(F.col("target_id")), F.col("type")).alias("value"))
    ends = g.nodes.sparkSession.createDataFrame([(0, "digraph G {"), (3, "}")], "part int, value string")
    return ends.unionByName(n).unionByName(e)


def json_lines(g: PropertyGraph) -> DataFrame:
    n = g.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "*")).alias("value"))
    return n.unionByName(g.edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "*")).alias("value")))


# embeddings: magic, header length, JSON header, then per vector the id with its length and the floats


def encode_embeddings(rows: list[tuple[str, list[float]]], model: str = "") -> bytes:
    dim = len(rows[0][1]) if rows else 0
    head = json.dumps({"model": model, "dim": dim, "count": len(rows)}).encode()
    out = [MAGIC, struct.pack("<I", len(head)), head]
    for i, v in rows:
        b = i.encode()
        out += [struct.pack("<I", len(b)), b, struct.pack(f"<{dim}f", *v)]
    return b"".join(out)


def decode_embeddings(blob: bytes) -> list[tuple[str, list[float]]]:
    """The vectors of a file; a wrong magic, dimension or count is refused."""
    if blob[:8] != MAGIC:
        raise ValueError("no embedding file")
    (n,) = struct.unpack_from("<I", blob, 8)
    head, at, out = json.loads(blob[12 : 12 + n]), 12 + n, []
    while at < len(blob):
        (k,) = struct.unpack_from("<I", blob, at)
        out.append((blob[at + 4 : at + 4 + k].decode(), list(struct.unpack_from(f"<{head['dim']}f", blob, at + 4 + k))))
        at += 4 + k + 4 * head["dim"]
    if len(out) != head["count"]:
        raise ValueError(f"{len(out)} vectors, {head['count']} announced")
    return out


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for blob in pdf["content"]:
            yield pd.DataFrame(decode_embeddings(bytes(blob)), columns=["node_id", "embedding"])


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``node_id, embedding`` of binary embedding files, one task a file."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_decode, "node_id string, embedding array<float>")


def read_source_tree(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all files below a folder, paths relative to it."""
    f = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("content"))
    root = path.rstrip("/") + "/"
    return f.select(F.substring_index(F.regexp_replace("full", "^file:/+", "/"), root, -1).alias("path"), "content")


def registry(df: DataFrame, what: str | None = None) -> DataFrame:
    """The latest entry of each repository, or that of one name or path."""
    k = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("indexed_at"), "path"))
    d = df.withColumn("k", k).where("k = 1").drop("k")
    return d.where((F.col("name") == what) | (F.col("path") == what)) if what else d


# history


def parse_git_log(lines: DataFrame) -> DataFrame:
    """``commit, ts, author, email, file, added, removed`` of ``git log --numstat`` output.

    ``lines`` has ``log`` (which log), ``line`` (number) and ``text``; headers read ``COMMIT:hash|iso date|author|email``.
    Headers are carried down to the lines of their log by a window per log.
    """
    w = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("text").startswith("COMMIT:"), F.substring_index("text", "COMMIT:", -1))
    d = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).where(F.col("text").rlike(r"^(?:\d+|-)\t(?:\d+|-)\t"))
    h, p = F.split("head", r"\|"), F.split("text", "\t")
    n = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    return d.select(h[0].alias("commit"), F.to_timestamp(h[1]).alias("ts"), h[2].alias("author"), h[3].alias("email"), p[2].alias("file"), n(p[0]).alias("added"), n(p[1]).alias("removed"))


def parse_diff(lines: DataFrame) -> DataFrame:
    """``file, start, end`` of the hunks of a unified diff without context (``log, line, text``)."""
    w = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("text").startswith("+++ "), F.regexp_replace("text", r"^\+\+\+ (?:b/)?", ""))
    rx = r"^@@ -\S+ \+(\d+)(?:,(\d+))? @@"
    d = lines.withColumn("file", F.last(name, ignorenulls=True).over(w)).where(F.col("text").rlike(rx))
    start = F.regexp_extract("text", rx, 1).cast("long")
    count = F.coalesce(F.regexp_extract("text", rx, 2).try_cast("long"), F.lit(1))
    return d.select("file", start.alias("start"), (start + F.greatest(count, F.lit(1)) - 1).alias("end"))


def docx_text(blob: bytes) -> str:
    """Paragraphs of a word-processor file, headings as Markdown."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        text = "".join(t.text or "" for t in p.iter(f"{w}t"))
        style = p.find(f"{w}pPr/{w}pStyle")
        level = re.search(r"(\d)$", style.get(f"{w}val", "")) if style is not None and "eading" in style.get(f"{w}val", "") else None
        out.append("#" * int(level[1]) + " " + text if level else text)
    return "\n\n".join(x for x in out if x.strip())


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"source_path": pdf["path"], "content": [docx_text(bytes(b)) for b in pdf["content"]]})


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``source_path, content`` of word-processor files, ready for chunking."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(_docx, "source_path string, content string")
