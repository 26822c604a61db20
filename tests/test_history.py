import datetime as dt
import random

from lexloom.operators.dedup import latest_delivery
from lexloom.operators.history import snapshot_changes, snapshot_history

D = [dt.date(2020, m, 1) for m in range(1, 13)]


def brute(rows, carry=True):
    by = {}
    for k, at, s, v in rows:
        if k is not None and at is not None:
            old = by.setdefault(k, {}).get(at)
            new = (s, v)
            key = lambda t: tuple((x is not None, x or "") for x in t)
            by[k][at] = new if old is None or key(new) > key(old) else old
    out = set()
    for k, snaps in by.items():
        told, periods = None, []
        for at in sorted(snaps):
            s, v = snaps[at]
            if carry:
                told = s if s is not None else told
                s = told
            if not periods or periods[-1][1] != (s, v):
                periods.append((at, (s, v)))
        for (a, st), nxt in zip(periods, [*[p[0] for p in periods[1:]], None], strict=True):
            out.add((k, a, nxt, *st))
    return out


def test_history_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "c", "d", None]), r.choice([*D, None]), r.choice(["0", "1", None]), r.choice(["x", "y", None])) for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "k string, at date, s string, v string")
    got = [tuple(x) for x in snapshot_history(df, "k", "at", ["s", "v"], carry=["s"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_missing_snapshots_end_or_not(spark):
    rows = [("a", D[0], "0"), ("a", D[2], "0"), ("b", D[0], "1"), ("b", D[1], "1"), ("c", D[2], "1")]
    df = spark.createDataFrame(rows, "k string, at date, s string")
    kept = {tuple(x) for x in snapshot_changes(df, "k", "at", ["s"]).select("k", "at", "change").collect()}
    assert kept == {("a", D[0], "inserted"), ("b", D[0], "inserted"), ("c", D[2], "inserted")}
    closed = {tuple(x) for x in snapshot_changes(df, "k", "at", ["s"], close_missing=True).select("k", "at", "change").collect()}
    assert closed == {("a", D[0], "inserted"), ("a", D[1], "deleted"), ("a", D[2], "inserted"), ("b", D[0], "inserted"), ("b", D[2], "deleted"), ("c", D[2], "inserted")}
    periods = {tuple(x) for x in snapshot_history(df, "k", "at", ["s"], close_missing=True).collect()}
    assert ("a", D[0], D[1], "0") in periods and ("b", D[0], D[2], "1") in periods


def test_empty_and_clashing_columns(spark):
    schema = "k string, at date, s string, _k int, change string, s0 string, valid_to int"
    assert snapshot_history(spark.createDataFrame([], schema), "k", "at", ["s"]).count() == 0
    df = spark.createDataFrame([("a", D[0], None, 1, "x", "y", 2)], schema)
    assert [tuple(x) for x in snapshot_history(df, "k", "at", ["s"]).collect()] == [("a", D[0], None, None)]


def test_latest_delivery_ties_and_nulls(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("a", 2, "z"), ("b", None, "q"), ("b", 0, None), (None, 3, "n")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    assert {tuple(x) for x in latest_delivery(df, ["k"], "t", ["v"]).collect()} == {("a", 2, "z"), ("b", 0, None), (None, 3, "n")}
