import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import mixing as M
from codeloom.llm import packing as P
from codeloom.llm.tokens import token_counter


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_pack_is_a_packing(sizes):
    s = np.array(sizes, np.int64)
    w = P.pack(s, 50)
    used = np.bincount(w, s) if len(s) else np.array([0])
    assert len(w) == len(s) and used.max(initial=0) <= 50 and (w >= 0).all()


def test_differencing_balances():
    s = np.array(random.Random(1).choices(range(1, 100), k=400))
    sums = [s[p].sum() for p in P.differencing(s, 20)]
    assert sum(sums) == s.sum() and max(sums) - min(sums) <= 5
    assert P.differencing(np.array([], int), 3) == []
    assert sorted(map(len, P.differencing(np.array([5, 5, 5]), 3))) == [1, 1, 1]


def test_fill_rate():
    s = np.array(random.Random(2).choices(range(20, 300), k=1500))
    w = P.pack(s, 512)
    used = np.bincount(w, s)
    assert s.sum() / (512 * (w.max() + 1)) > 0.9 and used.max() <= 512 and np.quantile(used, 0.05) > 0.8 * used.max()  # nearly equal windows


SIZED = "doc_id long, n_tokens long, source string, copies int, capacity int"


def test_documents(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(1, 120), "s", 0, 0) for i in range(500)] + [(900, 250, "s", 0, 0), (901, 0, "s", 0, 0), (902, None, "s", 0, 0), (903, 100, "s", 0, 0), (903, 100, "s", 0, 0)]
    boxes = spark.createDataFrame([("a", 100), ("b", 1000), ("none", 0), ("null", None)], "container string, capacity_tokens long")
    out = P.pack_documents(spark.createDataFrame(rows, SIZED), boxes).collect()
    for box, cap in (("a", 100), ("b", 1000)):
        mine = [x for x in out if x["container"] == box]
        used = {}
        for x in mine:
            used.setdefault(x["window_id"], []).append(x)
        assert all(sum(x["n_tokens"] for x in w) + w[0]["unused"] == cap for w in used.values())
        per = {}
        for x in mine:
            per.setdefault(x["doc_id"], []).append((x["piece"], x["start_token"], x["n_tokens"]))
        for i, n, *_ in rows:
            if i != 903:
                assert sum(p[2] for p in per[i]) == (n or 0) and (len(per[i]) == 1 or n > cap)
        assert len(per[903]) == 2
    assert sorted(p for x in out if x["container"] == "a" and x["doc_id"] == 900 for p in [(x["piece"], x["n_tokens"])]) == [(0, 100), (1, 100), (2, 50)]
    again = P.pack_documents(spark.createDataFrame(rows[::-1], SIZED).repartition(7), boxes)
    key = lambda x: (x["container"], x["doc_id"], x["piece"], x["n_tokens"], x["window_id"])
    assert sorted(map(key, out)) == sorted(map(key, again.collect()))
    assert {x["container"]: x["n_tokens"] for x in P.packing_report(P.pack_documents(spark.createDataFrame(rows, SIZED), boxes)).collect()}["a"] == sum(n or 0 for _, n, *_ in rows)


def test_empty(spark):
    none, boxes = spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 100)], "container string, capacity_tokens long")
    assert P.pack_documents(none, boxes).count() == 0 and P.pack_documents(none, boxes.limit(0)).count() == 0
    assert M.mix(none, spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 500)), max_size=60), st.integers(0, 99))
def test_pivot_keeps_the_sum(items, seed):
    p, w = np.array([a for a, _ in items]), np.array([float(b) for _, b in items])
    q = M.pivot(np.arange(len(p)), p, w, seed, 0)
    frac = (q > 1e-9) & (q < 1 - 1e-9)
    assert frac.sum() <= 1 and ((q >= 0) & (q <= 1)).all() and abs((p * w).sum() - (q * w).sum()) < 1e-5 * max(1.0, w.sum())


def test_pivot_keeps_the_chances():
    p, w = np.array([0.3, 0.6, 0.5, 0.2]), np.array([3.0, 1.0, 2.0, 5.0])
    mean = np.mean([M.pivot(np.arange(4), p, w, s, 0) for s in range(4000)], axis=0)
    assert mean == pytest.approx(p, abs=0.03)


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 50)
    monkeypatch.setattr(M, "FAN_IN", 3)
    r = random.Random(5)
    rows = [(i, r.choice([40, 60, 90]) if i % 50 else 4000, "big", 0, 0) for i in range(2000)] + [(5000 + i, r.randrange(20, 90), "small", 0, 0) for i in range(200)] + [(7000, 50, None, 0, 0), (7001, 50, "other", 0, 0), (7002, 0, "big", 0, 0), (7003, None, "small", 0, 0)]
    d = spark.createDataFrame(rows, SIZED)
    t = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn = M.mix(d, t)
    out = drawn.collect()
    assert {x["source"] for x in out} == {"big", "small"} and max(x["copies"] for x in out if x["source"] == "big") == 1 and max(x["copies"] for x in out) <= 3
    rep = {x["source"]: x for x in M.mix_report(d, t, drawn).collect()}
    assert rep["big"]["actual_share"] == pytest.approx(7 / 9, abs=0.004) and rep["missing"]["actual_share"] == 0 and rep["small"]["most_copies"] == 3
    again = M.mix(d.repartition(5), t)
    assert sorted(map(tuple, out)) == sorted(map(tuple, again.collect()))


def test_tokens(spark):
    d = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("a" * 20000,)], "t string")
    n = [x[0] for x in d.select(token_counter()(F.col("t"))).collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 1 and n[4] > 100
