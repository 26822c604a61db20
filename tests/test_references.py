import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.operators.references import failed_references, orphan_report, pack_bits, unpack_bits


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.sets(st.integers(0, 65535), min_size=1, max_size=300), st.tuples(st.integers(0, 60000), st.integers(1, 5000)).map(lambda t: set(range(t[0], t[0] + t[1])))))
def test_bitmaps_keep_their_bits(offsets):
    packed = pack_bits(np.array(sorted(offsets)))
    assert set(np.flatnonzero(unpack_bits(packed))) == offsets
    assert len(packed) <= 8193


def test_dense_bitmap_form():
    offsets = np.array(sorted(random.Random(3).sample(range(65536), 30000)))
    packed = pack_bits(offsets)
    assert packed[:1] == b"b" and (np.flatnonzero(unpack_bits(packed)) == offsets).all()


def when(r):
    return dt.datetime(2023, 1, 1) + dt.timedelta(days=r.randrange(700), seconds=r.randrange(86400))


def test_cases_equal_brute_force(spark):
    r = random.Random(5)
    parents = {f"k{i}": (r.choice([None, when(r)]), r.choice([None, None, when(r)])) for i in range(80)}
    refs = [(i, r.choice([*parents, "gone1", "gone2", None, "k1", "k1"]), r.choice([when(r), when(r), None])) for i in range(900)]
    refs += refs[:30]
    # times that fall together
    refs += [(2000 + i, k, t) for i, (k, (a, b)) in enumerate(parents.items()) for t in (a, b) if t]
    want = []
    for i, k, t in refs:
        if k is None or t is None:
            continue
        if k not in parents:
            want.append((i, k, "missing"))
        elif parents[k][1] and parents[k][1] <= t:
            want.append((i, k, "deleted"))
        elif parents[k][0] and parents[k][0] > t:
            want.append((i, k, "late"))
    rdf = spark.createDataFrame([(i, k, t, "x") for i, k, t in refs], "ref int, key string, at timestamp_ntz, reason2 string")
    pdf = spark.createDataFrame([(k, a, b, 1) for k, (a, b) in parents.items()], "key string, first_seen timestamp_ntz, deleted_at timestamp_ntz, extra int")
    got = failed_references(rdf, pdf, "at")
    assert sorted(tuple(x) for x in got.select("ref", "key", "reason").collect()) == sorted(want)
    assert orphan_report(got, ["reason", "period"]).agg({"n_refs": "sum"}).head()[0] == len(want)


def test_no_parents_and_no_references(spark):
    refs = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1))], "ref int, key string, at timestamp_ntz")
    none = spark.createDataFrame([], "key string, first_seen timestamp_ntz, deleted_at timestamp_ntz")
    assert [r["reason"] for r in failed_references(refs, none, "at").collect()] == ["missing"]
    assert failed_references(refs.limit(0), none, "at").count() == 0
