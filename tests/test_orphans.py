import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.operators import orphans

REF, VER = "ref string, endpoint string, key string, at timestamp", "key string, at timestamp, deleted boolean"


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, orphans.RANGE - 1), max_size=60), st.booleans(), st.sets(st.integers(0, orphans.RANGE - 1), max_size=60))
def test_bitmaps_round_trip(on, dense, parent):
    a, b = np.zeros(orphans.RANGE, bool), np.zeros(orphans.RANGE, bool)
    a[list(on)] = True
    b[list(parent)] = True
    if dense:
        a[::3] = True
    assert (orphans.unpack(orphans.pack(a)) == a).all()
    assert set(orphans.and_not(orphans.pack(a), orphans.pack(b))) == set(np.flatnonzero(a & ~b))


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("least", [5000, 3])
def test_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(orphans, "HOT_LEAST", least)  # 3: the hot keys are split
    r = random.Random(2)
    keys = [f"k{i}" for i in range(60)] + ["K1", "k1 "]
    vers = [(r.choice(keys), day(r.randrange(120)), r.choice([True, False, False, None])) for _ in range(150)]
    vers += vers[:10] + [(None, day(3), False), ("k2", None, False)]
    refs = [(f"e{i}", r.choice(["source", "target"]), r.choice(keys + ["nowhere", None]), day(r.randrange(-5, 125)) + dt.timedelta(hours=r.randrange(24))) for i in range(400)]
    refs += refs[:20] + [("late", "source", "k3", None)] + [(f"hot{i}", "target", "k5", day(60)) for i in range(200)]
    want = set()
    for ref, end, key, at in refs:
        if key is None:
            continue
        past = [(t, not d) for k, t, d in vers if k == key and t is not None and at is not None and t <= at]
        if not past or not max(past)[1]:
            want.add((ref, end))
    got = [(x.ref, x.endpoint) for x in orphans.find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(vers, VER)).collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_empty_tables(spark):
    none_r, none_v = spark.createDataFrame([], REF), spark.createDataFrame([], VER)
    some = spark.createDataFrame([("e", "source", "k", day(1))], REF)
    assert orphans.find_orphans(none_r, none_v).count() == 0
    assert orphans.find_orphans(none_r, spark.createDataFrame([("k", day(0), False)], VER)).count() == 0
    assert orphans.find_orphans(some, none_v).count() == 1
    assert orphans.find_orphans(some, spark.createDataFrame([("k", day(0), False)], VER)).count() == 0
