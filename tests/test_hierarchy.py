import random

import pytest

from lexloom.operators.hierarchy import descendants, hierarchy


def brute(links):
    parent = {}
    for n, p in links:
        if n is not None:
            parent[n] = p if n not in parent or parent[n] is None or (p is not None and p > parent[n]) else parent[n]
    out = {}
    for n in parent:
        path, seen, at = [n], {n}, n
        while parent[at] is not None and parent[at] in parent:
            at = parent[at]
            if at in seen:
                path = None
                break
            seen.add(at)
            path.append(at)
        out[n] = (None, -1, True, []) if path is None else (path[-1], len(path) - 1, False, path[::-1])
    return out


def compare(spark, links, rows):
    df = spark.createDataFrame(links, "n string, p string")
    got = hierarchy(df, "n", "p", paths=True, fragment_rows=rows).collect()
    want = brute(links)
    assert len(got) == len(want)
    for r in got:
        assert (r["root"], r["depth"], r["cyclic"], list(r["path"])) == want[r["n"]], r
    plain = {r["n"]: (r["root"], r["depth"], r["cyclic"]) for r in hierarchy(df, "n", "p", fragment_rows=rows).collect()}
    assert plain == {n: v[:3] for n, v in want.items()}


@pytest.mark.parametrize("rows", [1000, 25])
def test_random_forests_with_cycles(spark, rows):
    r = random.Random(rows)
    names = [f"n{r.randrange(10**6)}" for _ in range(60)]
    links = [(n, r.choice([*names, None, "nowhere"])) for n in names]
    links += links[:10] + [(None, names[0]), ("self", "self"), ("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("below", "a1")]
    compare(spark, links, rows)


def test_chain_across_all_fragments(spark):
    names = [f"{(i * 20) % 41:03d}" for i in range(41)]  # neighbours on the chain never share a fragment
    links = [(a, b) for a, b in zip(names, names[1:], strict=False)] + [(names[-1], None)]
    compare(spark, links, 14)


def test_long_cycle_across_fragments(spark):
    names = [f"{(i * 20) % 41:03d}" for i in range(41)]
    compare(spark, [(a, b) for a, b in zip(names, [*names[1:], names[0]], strict=True)] + [("t", names[3])], 14)


def test_empty_and_clashing_columns(spark):
    schema = "n string, p string, node string, exit string, hops int, top string, cyclic int"
    assert hierarchy(spark.createDataFrame([], schema), "n", "p").count() == 0
    df = spark.createDataFrame([("b", "a", "x", "y", 1, "z", 0), ("a", None, None, None, None, None, None)], schema)
    tree = hierarchy(df, "n", "p", paths=True)
    assert {(r["n"], r["root"], r["depth"]) for r in tree.collect()} == {("a", "a", 0), ("b", "a", 1)}
    assert [tuple(r) for r in descendants(tree, "n").collect()] == [("a", "b", 1)]
