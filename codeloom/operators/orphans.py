"""References to records that do not exist: bitmaps by key range and period.

Keys (strings) are encoded as integers by a dictionary; 32 768 consecutive codes form a range. For every range and
month there is one bitmap of the keys referred to and one of the keys that are live for the whole month; reference
AND-NOT parent leaves the bits worth a second look, and only these are decoded. A key whose state changes within the
month is exact only by the instant, so its surviving bits carry the month's changes along.

Bitmaps are compressed like roaring containers: at most 2 048 set bits are kept as 16-bit positions, more as bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize, month_index

RANGE_BITS = 15
RANGE = 1 << RANGE_BITS
ARRAY_MOST = RANGE // 16
HOT_LEAST, HOT_SHARE = 5000, 1000  # a key and month with more references than both say is split
NEVER = -1  # period of references without an instant


def pack(bits: np.ndarray) -> bytes:
    """A boolean array of RANGE bits as a compressed container."""
    on = np.flatnonzero(bits)
    return b"A" + on.astype("<u2").tobytes() if len(on) <= ARRAY_MOST else b"B" + np.packbits(bits).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"A":
        bits = np.zeros(RANGE, bool)
        bits[np.frombuffer(blob, "<u2", offset=1)] = True
        return bits
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=1)).astype(bool)


def and_not(reference: bytes, parent: bytes) -> np.ndarray:
    """Positions of the bits of reference that parent lacks."""
    if reference[:1] == b"A":
        at = np.frombuffer(reference, "<u2", offset=1).astype(np.int64)
        return at[~unpack(parent)[at]]
    return np.flatnonzero(unpack(reference) & ~unpack(parent))


def _pack_refs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(RANGE, bool)
    bits[pdf["bit"].to_numpy()] = True
    return pd.DataFrame({"rng": [key[0]], "period": [key[1]], "bitmap": [pack(bits)]})


def _survivors(refs: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
    """Of one range: at most RANGE keys, one bitmap a period, and the months in which states change."""
    out = []
    live = np.zeros(RANGE, bool)
    changes = {p: g for p, g in states.groupby("period")}
    maps = dict(zip(refs["period"], refs["bitmap"]))
    rng = refs["rng"].iloc[0] if len(refs) else 0
    for period in sorted({*changes, *maps}):
        whole, mixed = live, None
        if (g := changes.get(period)) is not None:
            bit, status = g["bit"].to_numpy(), g["status"].to_numpy()
            whole = live.copy()
            whole[bit] = status == 1
            mixed = bit[status == 2]
            live = live.copy()
            live[bit] = g["last_live"].to_numpy().astype(bool)
        if period in maps:
            at = and_not(maps[period], pack(whole))
            out.append(pd.DataFrame({"code": (int(rng) << RANGE_BITS) + at, "period": period, "mixed": np.isin(at, mixed) if mixed is not None else False}))
    return pd.concat(out) if out else pd.DataFrame({"code": np.array([], "int64"), "period": np.array([], "int32"), "mixed": np.array([], bool)})


def version_states(nodes: DataFrame) -> DataFrame:
    """``key, period, status, s0, last_live, changes``: one row a key and month in which it has a version.

    status: 0 dead, 1 live for the whole month, 2 mixed. s0: live when the month begins. changes: instants at which
    the state changes, in order. Of a tombstone and a live row of one instant the live one counts; a null is_deleted
    is false; rows without key or instant are left out.
    """
    v = nodes.where("key is not null and at is not null").groupBy("key", "at").agg(F.bool_or(~F.coalesce("deleted", F.lit(False))).alias("live")).withColumn("period", month_index(F.col("at")))
    in_month = Window.partitionBy("key", "period").orderBy("at")
    v = v.withColumn("before", F.lag("live").over(in_month)).where(F.col("before").isNull() | (F.col("before") != F.col("live")))
    m = v.groupBy("key", "period").agg(
        F.max_by("live", "at").alias("last_live"), F.bool_or("live").alias("any_live"), F.bool_or(~F.col("live")).alias("any_dead"), F.array_sort(F.collect_list(F.struct("at", "live"))).alias("changes")
    )
    m = m.withColumn("s0", F.coalesce(F.lag("last_live").over(Window.partitionBy("key").orderBy("period")), F.lit(False)))
    status = F.when(F.col("s0") & ~F.col("any_dead"), 1).when(~F.col("s0") & ~F.col("any_live"), 0).otherwise(2)
    return m.select("key", "period", status.cast("int").alias("status"), "s0", "last_live", "changes")


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose key is not live at their instant.

    ``references``: ``ref`` (what refers), ``endpoint``, ``key``, ``at``. ``parents``: ``key, at, deleted``, one row a
    version. Keys compare byte for byte. Returns distinct ``ref, endpoint, key, period``. A null key is no reference;
    a reference without an instant is an orphan (period -1). Empty tables give the obvious result: without parents
    every reference is an orphan.
    """
    refs = references.where("key is not null").select("ref", "endpoint", "key", "at", F.coalesce(month_index(F.col("at")), F.lit(NEVER)).cast("int").alias("period"))
    pairs = materialize(refs.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n")))
    # hot ones are split by their size; they are at most HOT_SHARE, since each holds more than that part of all references
    line = max(HOT_LEAST, (pairs.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(pairs.where(F.col("n") > line).select(F.col("key").alias("h_key"), F.col("period").alias("h_period"), F.ceil(F.col("n") / line).cast("int").alias("splits")))
    is_hot = (F.col("key") == F.col("h_key")) & (F.col("period") == F.col("h_period"))
    states = materialize(version_states(parents))
    # the dictionary: all keys once; written, so that the numbers stay the same for every later reader
    words = materialize(pairs.select("key").union(states.select("key")).distinct().withColumn("wide", F.monotonically_increasing_id()))
    # partition and row number of the wide number, without the gap between them, keep a range of codes within a partition
    words = words.select("key", F.col("wide").alias("code"), F.shiftright("wide", RANGE_BITS).alias("rng"), F.col("wide").bitwiseAND(RANGE - 1).cast("int").alias("bit"))
    ref_maps = pairs.join(words, "key").select("rng", "period", "bit").groupBy("rng", "period").applyInPandas(_pack_refs, "rng long, period int, bitmap binary")
    state_bits = states.join(words, "key").select("rng", "bit", "period", "status", "last_live")
    left = ref_maps.groupBy("rng").cogroup(state_bits.groupBy("rng")).applyInPandas(_survivors, "code long, period int, mixed boolean")
    decoded = left.join(words.select("code", "key"), "code").join(states.select("key", "period", "s0", "changes"), ["key", "period"], "left")
    decoded = decoded.select("key", "period", "mixed", F.when(F.col("mixed"), F.col("s0")).alias("s0"), F.when(F.col("mixed"), F.col("changes")).alias("changes"))
    # the surviving side is small, and its hot rows are repeated for each split of their references
    salted = decoded.join(hot, is_hot, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1))).drop("h_key", "h_period", "splits")
    spread_ = refs.join(hot, is_hot, "left").withColumn("salt", F.when(F.col("splits").isNotNull(), F.pmod(F.xxhash64("ref", "at"), F.col("splits"))).otherwise(0).cast("int"))
    hit = spread_.drop("h_key", "h_period", "splits").join(salted, ["key", "period", "salt"])
    dead = ~F.col("mixed") | ~F.coalesce(F.try_element_at(F.transform(F.filter("changes", lambda c: c["at"] <= F.col("at")), lambda c: c["live"]), F.lit(-1)), F.col("s0"))
    return hit.where(dead).select("ref", "endpoint", "key", "period").distinct()


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as references, in one pass over the table."""
    ends = F.array(*(F.struct(F.lit(e).alias("endpoint"), F.col(f"{e}_id").alias("key")) for e in ("source", "target")))
    return edges.select(F.col("id").alias("ref"), F.col("recorded_at").alias("at"), F.explode(ends).alias("e")).select("ref", "at", "e.endpoint", "e.key")


def node_versions(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("key"), F.col("indexed_at").alias("at"), F.col("is_deleted").alias("deleted"))
