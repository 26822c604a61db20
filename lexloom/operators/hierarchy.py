"""Parent–child links to full hierarchies.

Chains of parents inside a partition contract to their exits from it; the exits form a smaller
quotient forest, which is solved in the same way, and the fragments then expand. Partitions are
ranges of the node key, so that nodes with a common prefix meet, and hold a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

#: Rows that one task contracts at a time.
FRAGMENT_ROWS = 100_000
#: A quotient that keeps more than this share of its rows first halves its chains by a join.
SHRINK = 0.75


def _contract(batches: Iterator[pd.DataFrame], paths: bool) -> Iterator[pd.DataFrame]:
    """Follow parents inside the partition: node → (top, hops) of the last node reached and its exit."""
    parts = list(batches)
    if not any(map(len, parts)):
        return
    pdf = pd.concat(parts, ignore_index=True)
    n = len(pdf)
    parent = pdf["exit"].to_numpy(object)
    at = pd.Index(pdf["node"]).get_indexer(pd.Index(pdf["exit"]))
    at[pd.isna(pdf["exit"]).to_numpy()] = -1
    own = np.arange(n)
    jump = np.where(at < 0, own, at)
    hops = np.where(at < 0, 0, pdf["hops"].to_numpy(np.int64) + 1)
    for _ in range(ceil(log2(n + 1)) + 1):
        hops = hops + hops[jump]
        jump = jump[jump]
    stuck = at[jump] >= 0
    cyclic = stuck | pdf["cyclic"].to_numpy(bool)[jump]
    out = pd.DataFrame({"node": pdf["node"], "top": pdf["top"].to_numpy(object)[jump], "exit": parent[jump], "hops": np.where(stuck, 0, hops + pdf["hops"].to_numpy(np.int64)[jump]), "cyclic": cyclic})
    out.loc[cyclic, "exit"] = None
    if paths:
        own_path = pdf["path"].to_list()
        full: list = [None] * n
        for i in np.argsort(np.where(stuck, -1, hops), kind="stable"):
            full[i] = [] if cyclic[i] else list(own_path[i]) if at[i] < 0 else full[at[i]] + list(own_path[i])
        out["path"] = full
    yield out


def _solve(links: DataFrame, paths: bool, fragment_rows: int, jumps: int) -> DataFrame:
    """(node, top, exit, hops, cyclic[, path]) with every exit that is itself a node resolved."""
    count = links.count()
    parts = max(1, ceil(count / fragment_rows))
    cols = ["node", "top", "exit", "hops", "cyclic"] + (["path"] if paths else [])
    schema = links.select(*cols).schema
    spread = links.coalesce(1) if parts == 1 else links.repartitionByRange(parts, "node")
    local = spread.select(*cols).mapInPandas(lambda it: _contract(it, paths), schema)
    if parts == 1:
        return local
    local = materialize(local)
    exits = local.where("exit is not null").select(F.col("exit").alias("node")).distinct()
    quotient = materialize(local.join(exits, "node", "left_semi"))
    left = quotient.count()
    if not left:
        return local
    if left > SHRINK * count:
        if jumps <= 0:  # chains longer than there are nodes: what is still open never ends
            return _mark_open(local, quotient, paths)
        quotient = materialize(_jump(quotient, paths))
        jumps -= 1
    return _expand(local, _solve(quotient, paths, fragment_rows, jumps), paths)


def _expand(local: DataFrame, solved: DataFrame, paths: bool) -> DataFrame:
    """Lengthen each fragment by the solution of its exit; an exit that is no node ends the chain."""
    s = solved.select(F.col("node").alias("_n"), F.col("top").alias("_top"), F.col("exit").alias("_exit"), F.col("hops").alias("_hops"), F.col("cyclic").alias("_cyc"), *([F.col("path").alias("_path")] if paths else []))
    hit = F.col("_n").isNotNull()
    return local.join(s, local["exit"] == s["_n"], "left").select(
        "node", F.coalesce("_top", "top").alias("top"), F.when(hit, F.col("_exit")).otherwise(F.col("exit")).alias("exit"),
        F.when(hit, F.col("hops") + 1 + F.col("_hops")).otherwise(F.col("hops")).alias("hops"), (F.col("cyclic") | F.coalesce("_cyc", F.lit(False))).alias("cyclic"),
        *([F.when(hit, F.concat("_path", "path")).otherwise(F.col("path")).alias("path")] if paths else []),
    )


def _jump(quotient: DataFrame, paths: bool) -> DataFrame:
    """Each open chain takes over the chain of its exit: lengths halve."""
    return _expand(quotient, quotient, paths)


def _mark_open(local: DataFrame, quotient: DataFrame, paths: bool) -> DataFrame:
    going = quotient.select(F.col("node").alias("_n"))
    marked = quotient.join(going, quotient["exit"] == going["_n"], "left").withColumn("cyclic", F.col("cyclic") | F.col("_n").isNotNull()).drop("_n")
    return _expand(local, marked, paths)


def hierarchy(links: DataFrame, node: str, parent: str, paths: bool = False, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Root, depth and, if asked for, path of every node of a forest of unknown depth.

    ``links`` has one row per node; of repeated nodes the greatest parent counts, rows with a null
    node are ignored. A node whose parent is null or no node itself is a root of depth 0. Returns
    (node, root, depth, cyclic[, path]): nodes on a cycle and all nodes below one are ``cyclic``
    with a null root, depth -1 and an empty path; else ``path`` runs from the root to the node.
    An empty table gives no rows.
    """
    kind = links.schema[node].dataType
    start = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.max(F.col(parent).cast(kind)).alias("exit"))
    start = start.select("node", F.col("node").alias("top"), "exit", F.lit(0).cast("long").alias("hops"), F.lit(False).alias("cyclic"), *([F.array("node").alias("path")] if paths else []))
    start = materialize(start)
    solved = _solve(start, paths, fragment_rows, jumps=2 * ceil(log2(start.count() + 2)) + 2)
    cyc = F.col("cyclic")
    out = solved.select(F.col("node").alias(node), F.when(~cyc, F.col("top")).alias("root"), F.when(cyc, -1).otherwise(F.col("hops")).cast("long").alias("depth"), cyc.alias("cyclic"), *([F.when(cyc, F.array().cast(f"array<{kind.simpleString()}>")).otherwise(F.col("path")).alias("path")] if paths else []))
    return out


def descendants(paths: DataFrame, node: str) -> DataFrame:
    """(ancestor, descendant, distance) of every node with its path; a node isn't its own descendant."""
    step = F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("_pos", "ancestor")
    return paths.where(~F.col("cyclic")).select(F.col(node).alias("descendant"), (F.size("path") - 1).alias("_d"), step).select("ancestor", "descendant", (F.col("_d") - F.col("_pos")).cast("long").alias("distance"))
