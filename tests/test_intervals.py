import random

import pytest

from lexloom.operators.intervals import LEVELS, covered_spans, dyadic_blocks


def brute(rows):
    out = set()
    by = {}
    for k, a, b in rows:
        if k is not None and a is not None and b is not None and max(a, 0) < min(b, 1 << LEVELS):
            by.setdefault(k, []).append((max(a, 0), min(b, 1 << LEVELS)))
    for k, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_brute_force(spark, seed):
    r = random.Random(seed)
    width = [20, 300, 5000, 1 << LEVELS][seed]
    rows = []
    for _ in range(600):
        a = r.randrange(-3, width)
        rows.append((r.choice("abcdefghij"), a, a + r.randrange(-2, max(3, width // 10))))
    rows += rows[:50] + [("z", None, 5), ("z", 5, None), (None, 1, 4), ("y", 7, 7), ("y", 9, 8), ("w", 0, 1 << LEVELS), ("w", 5, 6)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = [tuple(x) for x in covered_spans(df, ["k"], "a", "b").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_hot_key_and_small_batches(spark):
    rows = [("hot", i * 3 % 5000, i * 3 % 5000 + 2) for i in range(4000)] + [(f"k{i}", i, i + 1) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(x) for x in covered_spans(df, ["k"], "a", "b").collect()} == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_blocks_tile_the_interval(spark):
    df = spark.createDataFrame([("x", 5, 37), ("y", 0, 1 << LEVELS), ("z", 12, 13)], "k string, a int, b int")
    cells = {}
    for k, level, idx in dyadic_blocks(df, ["k"], "a", "b").collect():
        for c in range(idx << level, min((idx + 1) << level, 100)):
            assert c not in cells.setdefault(k, set())
            cells[k].add(c)
    assert cells["x"] == set(range(5, 37)) and cells["z"] == {12} and cells["y"] == set(range(100))


def test_empty_and_clashing_columns(spark):
    schema = "k string, a int, b int, level string, idx string, span_kind string, _a int"
    empty = spark.createDataFrame([], schema)
    assert covered_spans(empty, ["k"], "a", "b").count() == 0
    df = spark.createDataFrame([("x", 1, 3, "q", None, "w", 9), ("x", 3, 4, None, "q", "w", 9)], schema)
    assert [tuple(r) for r in covered_spans(df, ["k"], "a", "b").collect()] == [("x", "period", 1, 4)]


def test_several_keys(spark):
    df = spark.createDataFrame([("x", 1, 1, 3), ("x", 2, 3, 4), ("x", 1, 5, 6)], "k string, n int, a int, b int")
    got = {tuple(r) for r in covered_spans(df, ["k", "n"], "a", "b").collect()}
    assert got == {("x", 1, "period", 1, 3), ("x", 1, "period", 5, 6), ("x", 1, "gap", 3, 5), ("x", 2, "period", 3, 4)}
