"""Property-graph operators on nodes and edges (src, dst, type)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialize


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: each property of a node is the new one, or the old one where the new is null."""
    props = [c for c in old.columns if c != key]
    o = old.select(F.col(key).alias("_ok"), *[F.col(c).alias(f"_o_{c}") for c in props])
    n = new.select(F.col(key).alias("_nk"), *[F.col(c).alias(f"_n_{c}") for c in props])
    both = n.join(o, F.col("_nk") == F.col("_ok"), "full_outer")
    state = F.when(F.col("_ok").isNull(), "created").when(F.col("_nk").isNull(), "kept").otherwise("merged")
    return both.select(F.coalesce("_nk", "_ok").alias(key), *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in props], state.alias("upsert_state"))


def valid_edges(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Distinct edges whose two ends are nodes."""
    ends = nodes.select(F.col(node).alias("_n")).distinct()
    once = edges.dropDuplicates(["src", "dst", "type"])
    return once.join(ends, once["src"] == ends["_n"], "left_semi").join(ends, once["dst"] == ends["_n"], "left_semi")


def failed_edges(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Distinct edges that lack an end, with the reason."""
    ends = nodes.select(F.col(node).alias("_n")).distinct()
    once = edges.dropDuplicates(["src", "dst", "type"])
    s, d = ends.withColumnRenamed("_n", "_s"), ends.withColumnRenamed("_n", "_d")
    joined = once.join(s, F.col("src") == F.col("_s"), "left").join(d, F.col("dst") == F.col("_d"), "left")
    reason = F.concat_ws("; ", F.when(F.col("_s").isNull(), "source missing"), F.when(F.col("_d").isNull(), "target missing"))
    return joined.where("_s is null or _d is null").select("src", "dst", "type", reason.alias("reason"))


def edges_by_key(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str, child_id: str, kind: str) -> DataFrame:
    """Edges from each parent to the children that name it."""
    p = parents.select(F.col(parent_key).alias("src")).where("src is not null").distinct()
    c = children.select(F.col(child_key).alias("src"), F.col(child_id).alias("dst")).distinct()
    return c.join(p, "src").select("src", "dst", F.lit(kind).alias("type"))


#: Nodes of a frontier that is sent to the edges; larger ones meet them by a shuffle.
MAX_FRONTIER = 200_000


def traverse(seeds: DataFrame, edges: DataFrame, depth: int, types: Sequence[str] | None = None) -> DataFrame:
    """(seed, node, length): nodes within ``depth`` undirected steps of each seed, by the shortest way.

    Each step joins the last frontier with the edges from both ends and drops what is already
    reached, so that hubs are left once. A frontier that is counted to be small is broadcast, so the
    edges are neither shuffled nor kept; a larger one is joined by a shuffle whose hubs the adaptive
    skew join splits. Edges are read once a step: keep them if they are costly to derive. Cut after
    every step, plans stay short.
    """
    used = edges if types is None else edges.where(F.col("type").isin(*types))
    both = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    ways = used.where("src is not null and dst is not null").select(both.alias("w")).select("w.a", "w.b")
    reached = frontier = materialize(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("length")).distinct())
    for step in range(1, depth + 1):
        small = frontier.count() <= MAX_FRONTIER
        from_here = frontier.select("seed", F.col("node").alias("a"))
        found = ways.join(F.broadcast(from_here) if small else from_here, "a").select("seed", F.col("b").alias("node")).distinct()
        frontier = materialize(found.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("length", F.lit(step)))
        reached = reached.unionByName(frontier)
    return reached.where("length > 0")


def path_prefixes(path: Column) -> Column:
    """All proper ancestors of a path such as /a/b/c: /a, /a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def path_pairs(nodes: DataFrame, node: str, path: str) -> DataFrame:
    """(ancestor, descendant) by paths: descendants' prefixes are exploded and joined, with no prefix test."""
    low = nodes.where(F.size(F.split(path, "/")) > 2).select(F.col(node).alias("descendant"), F.explode(path_prefixes(F.col(path))).alias("p"))
    high = nodes.select(F.col(node).alias("ancestor"), F.col(path).alias("p"))
    return low.join(high, "p").select("ancestor", "descendant")


def matches_pattern(path: Column, pattern: str) -> Column:
    """Wildcard test: the part before the first * is a prefix, the others occur anywhere; without * equality."""
    if "*" not in pattern:
        return path == pattern
    first, *others = pattern.split("*")
    test = path.startswith(first)
    for part in filter(None, others):
        test &= path.contains(part)
    return test


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def sequence_edges(df: DataFrame, group: str, order: Sequence[str], node: str, kind: str) -> DataFrame:
    """Edges between neighbours of a group in an order."""
    nxt = F.lead(node).over(Window.partitionBy(group).orderBy(*order))
    return df.select(F.col(node).alias("src"), nxt.alias("dst"), F.lit(kind).alias("type")).where("dst is not null")
