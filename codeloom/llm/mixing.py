"""Mixing sources to target weights: pivotal dependent rounding over a reduction tree.

The total is the greatest at which no source needs more copies than it may have. Every text of a source then has the
same expected number of copies; whole copies are given outright, the fraction is rounded. Two texts with open
fractions meet: mass moves from one to the other, by chance in either direction, until one of them is 0 or 1, such
that the expected copies of each text and the tokens of the pair stay as they are. A bucket of texts so ends with one
open text at most; these meet again in ever fewer buckets, until one text a source is left, which a last draw decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

BUCKET, FAN_IN, HEAVY = 20_000, 64, 4.0
_EPS = 1e-9


def _draw(seed: int, a: int, b: int, level: int) -> float:
    """A number in [0, 1) that depends on the pair alone."""
    h = hashlib.blake2b(f"{seed}|{a}|{b}|{level}".encode(), digest_size=8).digest()
    return int.from_bytes(h, "big") / 2**64


def pivot(order: np.ndarray, p: np.ndarray, w: np.ndarray, seed: int, level: int) -> np.ndarray:
    """Round fractions p of items with weights w > 0 pairwise; at most one stays open. Keeps sum(p * w) exactly."""
    p = p.astype(float).copy()
    held = -1
    for i in range(len(p)):
        if p[i] < _EPS or p[i] > 1 - _EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        # up: mass w_a * up moves to a; down: from a
        up = min((1 - p[a]) * w[a], p[b] * w[b])
        down = min(p[a] * w[a], (1 - p[b]) * w[b])
        move = up if _draw(seed, int(order[a]), int(order[b]), level) < down / (up + down) else -down
        p[a] += move / w[a]
        p[b] -= move / w[b]
        for x in (a, b):
            if p[x] < _EPS or p[x] > 1 - _EPS:
                p[x] = round(p[x])
        held = next((x for x in (a, b) if 0 < p[x] < 1), -1)
    return p


def _round(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_order", kind="stable")
        pdf["p"] = pivot(pdf["_order"].to_numpy(), pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy().astype(float), seed, level)
        return pdf

    return run


def expected_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, have_tokens, n_docs, mean_copies`` of every target source.

    The total is the least of max_repeats * have_tokens / target_share over the sources that have tokens; a source
    without tokens cannot contribute and the others keep their proportions.
    """
    have = sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("have_tokens"), F.count(F.lit(1)).alias("n_docs"))
    t = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").distinct()
    t = t.join(have, "source", "left").fillna({"have_tokens": 0, "n_docs": 0})
    total = t.where("have_tokens > 0").agg(F.min(F.col("max_repeats") * F.col("have_tokens") / F.col("target_share"))).first()[0] or 0.0
    mean = F.when(F.col("have_tokens") > 0, F.least(F.col("target_share") * F.lit(float(total)) / F.col("have_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return t.withColumn("mean_copies", mean)


def _tree(d: DataFrame, key: str, kind: str, most: int, seed: int) -> DataFrame:
    """Round the copies ``mean`` of all texts; ``d`` has source, <key>, n_tokens, mean, buckets."""
    d = d.withColumn("whole", F.floor(F.col("mean") + _EPS).cast("int")).withColumn("p", F.greatest(F.col("mean") - F.col("whole"), F.lit(0.0)))
    d = d.withColumn("_order", F.xxhash64(F.col(key), F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("_order"), F.col("buckets")).cast("long"))
    cols = ["source", key, "n_tokens", "whole", "p", "_order", "bucket"]
    schema = f"source string, {key} {kind}, n_tokens long, whole int, p double, _order long, bucket long"
    left, level, settled = d.select(*cols), 0, None
    while True:
        left = materialize(left.groupBy("source", "bucket").applyInPandas(_round(seed, level), schema))
        done = left.where("p = 0 or p = 1")
        settled = done if settled is None else settled.unionByName(done)
        left = left.where("p > 0 and p < 1")
        if most <= 1:
            break
        level, most = level + 1, -(-most // FAN_IN)
        left = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long")).select(*cols)
    # one open text a source: its fraction is the chance of one more copy
    chance = F.pmod(F.xxhash64("_order", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    settled = settled.unionByName(left.withColumn("p", F.when(chance < F.col("p"), 1.0).otherwise(0.0)))
    return settled.select("source", key, "n_tokens", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """``source, <key>, n_tokens, copies`` of every text that is drawn at least once.

    ``sized`` has ``<key>`` (unique), ``source``, ``n_tokens``; ``targets`` has ``source, target_share, max_repeats``.
    Texts of other or null sources and texts without tokens are not drawn. No text is drawn more than max_repeats
    times. Texts of more than HEAVY times the mean are rounded first and what their last draw leaves is spread over
    the other texts of the source, so that its tokens differ from the expected ones by less than one such other text.
    The same input gives the same draw, in whatever order it arrives.
    """
    goal = materialize(expected_copies(sized, targets))
    kind = dict(sized.dtypes)[key]
    most = int(goal.agg(F.max(F.ceil(F.col("n_docs") / BUCKET))).first()[0] or 0)
    g = goal.select(F.col("source").alias("g_source"), "mean_copies", F.col("max_repeats").cast("double").alias("cap"), F.ceil(F.col("n_docs") / BUCKET).alias("buckets"), (HEAVY * F.col("have_tokens") / F.col("n_docs")).alias("line"))
    # targets are a table of parameters with one row a source
    d = sized.where("n_tokens > 0").select("source", key, F.col("n_tokens").cast("long").alias("n_tokens")).join(F.broadcast(g), F.col("source") == F.col("g_source")).where("mean_copies > 0").withColumn("mean", F.col("mean_copies"))
    heavy = materialize(_tree(d.where("n_tokens > line"), key, kind, most, seed))
    short = heavy.join(F.broadcast(g), F.col("source") == F.col("g_source")).groupBy("source").agg(F.sum((F.col("mean_copies") - F.col("copies")) * F.col("n_tokens")).alias("short"))
    room = d.where("n_tokens <= line").groupBy("source").agg(F.sum("n_tokens").alias("room"))
    shift = room.join(short, "source", "left").select(F.col("source").alias("s_source"), (F.coalesce("short", F.lit(0.0)) / F.col("room")).alias("shift"))
    light = d.where("n_tokens <= line").join(F.broadcast(shift), F.col("source") == F.col("s_source")).withColumn("mean", F.least("cap", F.greatest(F.lit(0.0), F.col("mean") + F.col("shift"))))
    return heavy.unionByName(_tree(light, key, kind, most, seed + 1)).where("copies > 0")


def mix_report(sized: DataFrame, targets: DataFrame, drawn: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, drawn_tokens, n_docs, n_drawn, most_copies, max_repeats``."""
    r = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.count(F.lit(1)).alias("n_drawn"), F.max("copies").alias("most_copies"))
    all_ = r.agg(F.sum("drawn_tokens").alias("all_tokens"))
    j = expected_copies(sized, targets).join(r, "source", "left").join(F.broadcast(all_), F.lit(True), "left")
    share = F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0))
    return j.select("source", "target_share", share.alias("actual_share"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), "n_docs", F.coalesce("n_drawn", F.lit(0)).alias("n_drawn"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
