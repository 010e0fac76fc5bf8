"""Ranking: BM25, cosine, reciprocal rank fusion and what is built on them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.kernels import bytes_head, cosine, label_weight, path_weight, tokens
from codeloom.session import spread

K1, B, RRF_K = 1.2, 0.75, 60
#: Labels with a text index, and labels that the file search asks for.
INDEXED = ("Function", "Class", "Method", "Interface", "File", "Struct", "Trait", "Enum", "Variable", "Type", "Module", "Route", "Tool", "Controller", "ControllerAction", "View", "ScriptFile", "UiComponent", "Service", "Repository", "ExternalService")
SEARCHED = ("File", "Function", "Class", "Method", "Interface", "Controller", "ControllerAction", "ApiEndpoint", "View", "ViewModel", "DbEntity", "DbContext", "ScriptFile", "UiComponent", "Service", "Repository", "ExternalService")
PER_LABEL = 100


def query_terms(text: str) -> dict[str, int]:
    """Terms of a query with how often each occurs; a repeated term counts again."""
    return Counter(t for t in re.split(r"[\W_]+", text.lower()) if t)


def _is(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, key: str, text: Column, query: str, weight: Column | None = None) -> DataFrame:
    """``docs`` with ``score`` for every document that holds a term of the query.

    Length, document frequency and term frequency come from one pass over the documents; postings of other terms are
    never built, since the terms are known. Null texts count as empty documents.
    """
    terms = query_terms(query)
    base = spread(docs).withColumn("_terms", tokens(text))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_terms")).alias("total"), *[F.count_if(F.array_contains("_terms", t)).alias(f"df{i}") for i, t in enumerate(terms)])
    # one row
    joined = base.join(F.broadcast(stats.withColumn("avgdl", F.greatest(F.lit(1.0), F.coalesce(F.col("total"), F.lit(0)) / F.greatest(F.col("n"), F.lit(1))))), F.lit(True))
    score, hit = F.lit(0.0), F.lit(False)
    for i, (t, times) in enumerate(terms.items()):
        tf = F.size(F.filter("_terms", _is(t))).cast("double")
        idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1.0))
        score = score + times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("_terms") / F.col("avgdl")))
        hit = hit | F.array_contains("_terms", t)
    out = joined.where(hit).withColumn("score", score * (weight if weight is not None else F.lit(1.0)))
    return out.drop("_terms", "n", "total", "avgdl", *[f"df{i}" for i in range(len(terms))])


def postings(docs: DataFrame, key: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """The index as tables: ``term, <key>, tf`` and ``<key>, length``; for many queries over one corpus."""
    t = docs.select(key, tokens(text).alias("terms"))
    return t.select(key, F.explode("terms").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf")), t.select(key, F.size("terms").alias("length"))


BUCKETS = 256


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, key: str, text: Column, path: str) -> None:
    """Postings with the lengths of their documents, in folders by a hash of the term, and one row of statistics."""
    p, lengths = postings(docs, key, text)
    p.join(lengths, key).withColumn("bucket", _bucket(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).write.mode("overwrite").parquet(f"{path}/corpus")


def search_index(spark: SparkSession, path: str, key: str, query: str) -> DataFrame:
    """``<key>, score`` of every document with a term of the query, as :func:`bm25` gives it.

    Only the folders of the query's terms are read, and the terms are pushed down within them.
    """
    terms = query_terms(query)
    p = spark.read.parquet(f"{path}/postings")
    if not terms:
        return p.select(key, F.lit(0.0).alias("score")).limit(0)
    asked = spark.createDataFrame(list(terms.items()), "term string, times int")
    folders = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]  # as many as the query has words
    hit = p.where(F.col("bucket").isin(folders) & F.col("term").isin(list(terms)))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(asked), "term")  # as many rows as terms
    j = hit.join(F.broadcast(df), "term").join(F.broadcast(spark.read.parquet(f"{path}/corpus")), F.lit(True))
    avgdl = F.greatest(F.lit(1.0), F.col("total") / F.greatest(F.col("n"), F.lit(1)))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / avgdl))
    return j.groupBy(key).agg(F.sum(part).alias("score"))


def node_text(df: DataFrame) -> Column:
    """Name, path and description of a node."""
    return F.concat_ws(" ", "name", "file_path", *(["description"] if "description" in df.columns else []))


def _ranked(df: DataFrame, *tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *tie)))


def top(df: DataFrame, limit: int, *tie: str) -> DataFrame:
    """The best rows with their rank; the window sees only the rows that are left."""
    return _ranked(df.orderBy(F.desc("score"), *tie).limit(limit), *tie)


def bm25_nodes(nodes: DataFrame, query: str, labels: list[str] | None = None, limit: int = 20) -> DataFrame:
    """``rank, id, name, label, file_path, score`` of the best nodes; all indexed labels count for the statistics."""
    scored = bm25(nodes.where(F.col("label").isin(*INDEXED)), "id", node_text(nodes), query, path_weight(F.col("file_path")) * label_weight(F.col("label")))
    if labels:
        scored = scored.where(F.col("label").isin(*labels))
    return top(scored.select("id", "name", "label", "file_path", "score"), limit, "id")


def search_files(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Best symbol of each file: per searched label the first PER_LABEL hits, of them the best a file."""
    scored = bm25(nodes.where(F.col("label").isin(*INDEXED)), "id", node_text(nodes), query, path_weight(F.col("file_path")) * label_weight(F.col("label")))
    scored = scored.where(F.col("label").isin(*[x for x in SEARCHED if x in INDEXED]))
    first = scored.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id"))).where(F.col("k") <= PER_LABEL)
    best = first.withColumn("m", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "id"))).where("m = 1")
    return top(best.select("file_path", "score", F.col("id").alias("node_id"), "name", "label", *[c for c in ("start_line", "end_line") if c in nodes.columns]), limit, "node_id")


def semantic(vectors: DataFrame, key: str, query: list[float], limit: int = 20, vector: str = "embedding") -> DataFrame:
    """``rank, <key>, score``: exact cosine against every vector; a query without a norm is refused."""
    if not any(query):
        raise ValueError("the query vector has no norm")
    q = F.array(*[F.lit(float(x)) for x in query])
    return top(vectors.select(key, cosine(F.col(vector), q).alias("score")), limit, key)


def semantic_batch(vectors: DataFrame, queries: DataFrame, key: str, limit: int = 10, vector: str = "embedding", block: int = 20_000) -> DataFrame:
    """``query_id, <key>, score, rank``: the best rows for each of many queries, all rows compared.

    Rows and queries are cut into blocks by a hash of their key; a task multiplies one block of each and keeps the best
    of every query, the rest is a grouped merge. Vectors of another length than the query's, and such without a norm,
    score 0. Ties go to the least key.
    """
    kind = dict(vectors.dtypes)[key]
    n, m = vectors.count(), queries.count()
    nb, mb = max(1, -(-n // block)), max(1, -(-m // block))
    every = lambda c, k: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(c)
    rows = vectors.select(F.col(key), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(nb)).cast("int").alias("rb"), every("qb", mb))
    asks = queries.select(F.col(key), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(mb)).cast("int").alias("qb"), every("rb", nb))

    def best(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in q[q["v"].notna()].groupby(q["v"].str.len()):
            mine = r[r["v"].str.len() == dim].sort_values(key)
            if not len(mine):
                continue
            a, b = (np.stack(x["v"].to_numpy()).astype(float) for x in (part, mine))
            na, nb_ = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            s = np.divide(a @ b.T, np.outer(na, nb_), out=np.zeros((len(a), len(b))), where=np.outer(na, nb_) > 0)
            s = np.round(s, 12)
            at = np.argsort(-s, axis=1, kind="stable")[:, :limit]
            out.append(pd.DataFrame({"query_id": np.repeat(part[key].to_numpy(), at.shape[1]), key: mine[key].to_numpy()[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "score": []})

    near = rows.groupBy("rb", "qb").cogroup(asks.groupBy("rb", "qb")).applyInPandas(best, f"query_id {kind}, {key} {kind}, score double")
    k = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return near.withColumn("rank", k).where(F.col("rank") <= limit)


def fuse(*ranked: tuple[str, DataFrame], key: str = "node_id", limit: int = 20, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``<key>, rank``: ``rank, <key>, score, sources``."""
    all_ = None
    for name, df in ranked:
        part = df.select(key, (1.0 / (k + F.col("rank"))).alias("part"), F.lit(name).alias("source"))
        all_ = part if all_ is None else all_.unionByName(part)
    s = all_.groupBy(key).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return top(s, limit, key)


def hybrid(nodes: DataFrame, vectors: DataFrame, query: str, embed: Callable[[str], list[float]], limit: int = 20) -> DataFrame:
    """BM25 and vectors fused; if the query cannot be embedded, BM25 alone."""
    pool = max(limit, 20)
    words = search_files(nodes, query, pool)
    try:
        near = semantic(vectors, "node_id", embed(query), pool)
    except ValueError:
        return words.select("rank", "node_id", "score", F.array(F.lit("bm25")).alias("sources")).where(F.col("rank") <= limit)
    return fuse(("bm25", words), ("semantic", near), limit=limit)


def group_by_process(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``process_id, process, step_count, id, step``: hits (``id``) with the processes they are a step of, those of most
    steps first, then by step; hits of no process are definitions (null process) and come last."""
    steps = edges.where("type = 'STEP_IN_PROCESS'").select(F.col("source_id").alias("s_id"), F.col("target_id").alias("process_id"), "step")
    count = steps.groupBy(F.col("process_id").alias("c_id")).agg(F.count(F.lit(1)).alias("step_count"))
    names = nodes.where("label = 'Process'").select(F.col("id").alias("p_id"), F.col("name").alias("process"))
    j = hits.join(steps, F.col("id") == F.col("s_id"), "left").join(names, F.col("process_id") == F.col("p_id"), "left").join(count, F.col("process_id") == F.col("c_id"), "left")
    return j.drop("s_id", "p_id", "c_id").orderBy(F.desc_nulls_last("step_count"), "process_id", F.asc_nulls_last("step"), "id")


def search_code(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 10, neighbours: int = 5) -> DataFrame:
    """BM25 hits with their neighbours each way, filled up by names that hold the query (score 0)."""
    hits = bm25_nodes(nodes, query, limit=max(2 * limit, 20)).select("id", "name", "label", "file_path", "score")
    names = nodes.where(F.lower("name").contains(query.lower())).select("id", "name", "label", "file_path", F.lit(0.0).alias("score")).join(hits.select("id"), "id", "left_anti")
    best = top(hits.unionByName(names), limit, "id")
    kinds = ("CALLS", "CALLS_ACTION", "CALLS_SERVICE", "IMPORTS", "USES", "EXTENDS", "IMPLEMENTS")
    e = edges.where(F.col("type").isin(*kinds))

    def side(a: str, b: str, name: str) -> DataFrame:
        j = best.select("id").join(e.select(F.col(a).alias("id"), F.col(b).alias("other")).distinct(), "id")
        k = j.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("other"))).where(F.col("k") <= neighbours)
        return k.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias(name))

    return best.join(side("source_id", "target_id", "calls"), "id", "left").join(side("target_id", "source_id", "called_by"), "id", "left")


def embedding_text(nodes: DataFrame) -> DataFrame:
    """``node_id, text``: name, path, description and the head of the content; build artefacts are left out."""
    cols = [c for c in ("name", "file_path", "description") if c in nodes.columns] + ([bytes_head(F.col("content"), 1000)] if "content" in nodes.columns else [])
    kept = nodes.where(~F.coalesce(F.col("file_path").rlike(r"(?i)(?:^|/)(?:obj|bin|node_modules|packages)/|\.min\."), F.lit(False)))
    return kept.select(F.col("id").alias("node_id"), F.concat_ws(" ", *cols).alias("text"))


def embed_nodes(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, batch: int = 64) -> DataFrame:
    """``node_id, embedding`` of ``texts`` (``node_id, text``) by a model that every task loads once.

    ``load`` gives a callable from texts to vectors. Vectors are brought to length 1; a batch that fails, a vector of
    another length or without a norm becomes zeros, which no search finds.
    """

    def run(batches):
        model = load()
        for pdf in batches:
            out = np.zeros((len(pdf), dim), np.float32)
            for a in range(0, len(pdf), batch):
                try:
                    vectors = model([t or "" for t in pdf["text"].iloc[a : a + batch]])
                except Exception:
                    continue
                for i, v in enumerate(vectors[:batch]):
                    v = np.asarray(v, np.float32)
                    norm = float(np.linalg.norm(v)) if v.shape == (dim,) else 0.0
                    if norm > 0 and np.isfinite(norm):
                        out[a + i] = v / norm
            yield pd.DataFrame({"node_id": pdf["node_id"], "embedding": list(out)})

    return spread(texts.select("node_id", "text")).mapInPandas(run, "node_id string, embedding array<float>")


def clamp(limit: int | None, default: int, most: int) -> int:
    """A limit that a caller asks for, within 1 and the most a report may have."""
    return max(1, min(default if limit is None else limit, most))


def rerank(ranked: DataFrame, judge: Callable[[list[dict]], list[int]], most: int = 30) -> DataFrame:
    """Reorder the first rows by a callable that returns positions; none is invented or lost.

    Works on at most ``most`` rows on the driver, as a reranker is a service call over a short list.
    """
    rows = [r.asDict() for r in ranked.orderBy("rank").limit(most).collect()]
    order = [i for i in dict.fromkeys(judge(rows)) if isinstance(i, int) and 0 <= i < len(rows)]
    order += [i for i in range(len(rows)) if i not in set(order)]
    return ranked.sparkSession.createDataFrame([rows[i] | {"rank": k + 1} for k, i in enumerate(order)], ranked.schema)


def parse_ranking(text: str, n: int) -> list[int]:
    """Positions in a model's answer: any list of numbers from 1; strays and repeats are dropped."""
    return [i for i in dict.fromkeys(int(x) - 1 for x in re.findall(r"\d+", text)) if 0 <= i < n]
