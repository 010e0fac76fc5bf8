"""Filling containers of fixed capacity with texts: multiway differencing within balanced groups.

Items are spread by a hash over groups of about WINDOWS containers' worth of tokens, whose number follows the total,
so no task grows with the data. Within a group the method of Karmarkar and Karp merges partial partitions: the two
with the greatest imbalance are joined so that the fullest windows of one meet the emptiest of the other. The window
count starts at the least that the sizes allow and rises whenever a window exceeds the capacity, so that all windows of
a group are nearly equally full.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import materialize

WINDOWS = 400


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items of each of k windows by multiway differencing; some windows may be empty."""
    n = len(sizes)
    left, right = list(range(n)), [-1] * n  # nodes of the merge trees: items first, then joined windows
    heap = [(-int(s), i, (np.array([s]), np.array([i]))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, (a, an) = heapq.heappop(heap)
        _, _, (b, bn) = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the emptiest of a meet the fullest of b
            lo = len(a) - over
            joined = a[lo:] + b[:over][::-1]
            ids = np.arange(len(left), len(left) + over)
            left += an[lo:].tolist()
            right += bn[:over][::-1].tolist()
            sums, nodes = np.concatenate([a[:lo], joined, b[over:]]), np.concatenate([an[:lo], ids, bn[over:]])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, tick, (sums, nodes)))
        tick += 1
    out = []
    for root in heap[0][2][1].tolist() if heap else []:
        items, stack = [], [root]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x], right[x])
        out.append(items)
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; no window exceeds the capacity, which no item exceeds.

    The count starts at the least that the sizes allow and rises, by doubled steps, until differencing leaves no window
    too full; between the last count that failed and the first that did not, the least that works is found by halving.
    """
    window = np.full(len(sizes), -1, np.int64)
    full = sizes == capacity
    done = int(full.sum())
    window[full] = np.arange(done)
    window[sizes <= 0] = 0
    rest = np.flatnonzero((sizes > 0) & ~full)
    if not len(rest):
        return window

    def parts(k: int) -> list[list[int]] | None:
        p = differencing(sizes[rest], min(k, len(rest)))
        return p if all(int(sizes[rest[q]].sum()) <= capacity for q in p) else None

    low = max(-(-int(sizes[rest].sum()) // capacity), int((sizes[rest] * 2 > capacity).sum())) - 1  # too few
    high, step, best = low + 1, 1, None
    while (best := parts(high)) is None:
        low, high, step = high, high + step, 2 * step
    while high - low > 1:
        middle = (low + high) // 2
        if (p := parts(middle)) is None:
            low = middle
        else:
            high, best = middle, p
    for k, p in enumerate(best):
        window[rest[p]] = done + k
    return window


def _fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One group of one container; sorted first, so that the order of arrival does not matter."""
    pdf = pdf.sort_values(["n_tokens", "_order", "piece"], ascending=[False, True, True], kind="stable")
    sizes, capacity = pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0])
    window = pack(sizes, capacity)
    used = np.bincount(window, sizes, minlength=int(window.max()) + 1).astype(np.int64)
    pdf["window_id"] = (int(key[1]) << 24) + window
    pdf["unused"] = capacity - used[window]
    return pdf


def pack_documents(sized: DataFrame, containers: DataFrame, key: str = "doc_id") -> DataFrame:
    """``container, capacity, <key>, piece, start_token, n_tokens, window_id, unused`` for every text and container.

    ``sized`` has ``<key>`` and ``n_tokens``; ``containers`` (a table of parameters, a handful of rows) has
    ``container`` and ``capacity_tokens``. A text is one piece unless it alone exceeds the capacity; then it is cut
    into full windows and a rest, and ``start_token`` says where each piece begins. ``unused`` is the free space of
    the piece's window. Texts without tokens take no space and go into the first window of their group; a null size
    counts as 0. Repeated rows are separate items. Containers without a positive capacity are left out.
    """
    kinds = [(r["container"], int(r["capacity_tokens"])) for r in containers.where("capacity_tokens > 0").select("container", "capacity_tokens").distinct().collect()]
    items = sized.select(key, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    schema = f"container string, capacity long, {key} {dict(sized.dtypes)[key]}, piece int, start_token long, n_tokens long, _order long, grp int, window_id long, unused long"
    if not kinds:
        return items.sparkSession.createDataFrame([], schema).drop("_order", "grp")
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    per = F.array(*(F.struct(F.lit(c).alias("container"), F.lit(cap).cast("long").alias("capacity"), F.lit(max(1, round(total / (WINDOWS * cap)))).alias("groups")) for c, cap in kinds))
    p = items.withColumn("c", F.explode(per)).select("c.*", key, F.col("n_tokens").alias("whole"))
    p = p.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / F.col("capacity")).cast("int") - 1, F.lit(0)))))
    p = p.withColumn("start_token", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.least("capacity", F.col("whole") - F.col("start_token")))
    p = p.withColumn("_order", F.xxhash64(F.col(key), "piece")).withColumn("grp", F.pmod(F.col("_order"), F.col("groups")).cast("int"))
    return p.select("container", "capacity", key, "piece", "start_token", "n_tokens", "_order", "grp").groupBy("container", "grp").applyInPandas(_fill, schema).drop("_order", "grp")


def packing_report(packed: DataFrame) -> DataFrame:
    """``container, capacity, n_windows, n_tokens, unused_tokens, fill``."""
    w = packed.groupBy("container", "capacity", "window_id").agg(F.sum("n_tokens").alias("used"))
    r = w.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("used").alias("n_tokens"))
    return r.withColumn("unused_tokens", F.col("n_windows") * F.col("capacity") - F.col("n_tokens")).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_windows") * F.col("capacity")), 6))


def packing_faults(packed: DataFrame, sized: DataFrame, key: str = "doc_id") -> DataFrame:
    """``container, n_items, n_over, n_split, n_lost``: items placed; windows beyond their capacity or of wrong free
    space; items cut though they fit; items whose pieces do not add up to them. The last three must be 0."""
    w = packed.groupBy("container", "capacity", "window_id").agg(F.sum("n_tokens").alias("used"), F.min("unused").alias("a"), F.max("unused").alias("b"))
    over = w.groupBy("container").agg(F.count_if((F.col("used") > F.col("capacity")) | (F.col("a") != F.col("b")) | (F.col("used") + F.col("a") != F.col("capacity"))).alias("n_over"))
    d = packed.groupBy("container", "capacity", key).agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("kinds"))
    j = d.join(sized.select(key, F.coalesce("n_tokens", F.lit(0)).alias("whole")), key, "left")
    wrong = F.coalesce((F.col("placed") != F.col("whole")) | (F.col("pieces") != F.col("kinds")), F.lit(True))
    items = j.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.count_if((F.col("pieces") > 1) & (F.col("whole") <= F.col("capacity"))).alias("n_split"), F.count_if(wrong).alias("n_lost"))
    return items.join(over, "container").select("container", "n_items", "n_over", "n_split", "n_lost")


def size_documents(docs: DataFrame, counter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, n_tokens`` of every text; written once, so that texts are read and encoded once."""
    return materialize(docs.select(key, counter(F.col(text)).alias("n_tokens")))
