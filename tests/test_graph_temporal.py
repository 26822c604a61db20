import datetime as dt
import random

from lexloom.operators import graph as G
from lexloom.operators import temporal as T

DAY = dt.datetime(2000, 1, 1)


def some_versions(r, n):
    rows = []
    for i in range(n):
        a = r.randrange(3000)
        b = r.choice([None, a + r.randrange(1, 900)])
        rows.append((f"l{r.randrange(5)}", f"v{i}", DAY + dt.timedelta(a), None if b is None else DAY + dt.timedelta(b)))
    return rows


def test_overlaps_and_as_of_equal_brute_force(spark):
    r = random.Random(2)
    rows = some_versions(r, 80)
    v = spark.createDataFrame(rows, "law_uri string, uri string, start timestamp_ntz, end timestamp_ntz")
    want = {(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and (x[3] is None or x[3] > y[2])}
    assert {tuple(t) for t in T.overlapping_versions(v).collect()} == want
    events = [(f"l{r.randrange(6)}", i, DAY + dt.timedelta(r.randrange(3600))) for i in range(100)]
    e = spark.createDataFrame([(*x, "extra", "start?") for x in events], "law_uri string, id int, at timestamp_ntz, uri string, start string")
    got = {t["id"]: t["version_uri"] for t in T.as_of_join(e, v, "at").collect()}
    for law, i, at in events:
        last = max(((x[2], x[1], x[3]) for x in rows if x[0] == law and x[2] <= at), default=None, key=lambda t: t[:2])
        assert got[i] == (last[1] if last and (last[2] is None or last[2] > at) else None)


def test_chain_has_one_edge_less_than_versions(spark):
    v = spark.createDataFrame(some_versions(random.Random(4), 40), "law_uri string, uri string, start timestamp_ntz, end timestamp_ntz")
    assert T.version_chain(v).count() == 40 - v.select("law_uri").distinct().count()
    assert T.version_chain(v.limit(0)).count() == 0


def test_traversal_is_breadth_first(spark):
    r = random.Random(6)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.choice("AB")) for _ in range(45)] + [(None, "n1", "A"), ("n1", None, "A")]
    near = {}
    for a, b, _ in edges:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for seed in ("n0", "n1", "lonely"):
        level, seen = {seed}, {seed}
        for step in (1, 2, 3):
            level = {y for x in level for y in near.get(x, ())} - seen
            seen |= level
            want |= {(seed, y): step for y in level}
    df = G.traverse(spark.createDataFrame([("n0",), ("n1",), ("lonely",), ("n0",)], "seed string"), spark.createDataFrame(edges, "src string, dst string, type string"), 3)
    assert {(x["seed"], x["node"]): x["length"] for x in df.collect()} == want


def test_upsert_and_edges(spark):
    old = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "k string, p string, q string")
    new = spark.createDataFrame([("a", None, "y"), ("c", "3", None)], "k string, p string, q string")
    assert {tuple(x) for x in G.upsert(old, new, "k").collect()} == {("a", "1", "y", "merged"), ("b", "2", "x", "kept"), ("c", "3", None, "created")}
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "b", "T"), ("a", "z", "T"), (None, "b", "T")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "uri string")
    assert [tuple(x) for x in G.valid_edges(edges, nodes, "uri").collect()] == [("a", "b", "T")]
    assert {(x["dst"], x["reason"]) for x in G.failed_edges(edges, nodes, "uri").collect()} == {("z", "target missing"), ("b", "source missing")}


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-03",), ("2020-02-03T00:00:00",), ("03.02.2020",), ("20200203",), ("2020/02/03",), ("31.02.2020",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(T.parse_any_date(df["t"])).collect()]
    assert got == [dt.date(2020, 2, 3)] * 5 + [None] * 3
