"""References to records that are missing, deleted or arrive later.

Keys are encoded as integers; compressed bitmaps per key range and period hold the referenced keys
and the keys that exist throughout the period; reference AND-NOT parent leaves the bits to decode.
Only the references behind those bits are compared with the parents' exact times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

#: Bits of a key range; a range's bitmap of one period has at most 8 KB.
RANGE_BITS = 16
_REF, _LOAD, _DROP = 0, 1, 2


def pack_bits(offsets: np.ndarray) -> bytes:
    """Sorted distinct offsets below 2**16 in the smallest of three forms: array, runs or bitmap."""
    offsets = offsets.astype(np.int64)
    breaks = np.flatnonzero(np.diff(offsets) != 1)
    if 4 * (len(breaks) + 1) <= min(2 * len(offsets), 8192):
        first = offsets[np.concatenate([[0], breaks + 1])]
        last = offsets[np.concatenate([breaks, [len(offsets) - 1]])]
        return b"r" + np.stack([first, last]).astype("<u2").tobytes()
    if 2 * len(offsets) <= 8192:
        return b"a" + offsets.astype("<u2").tobytes()
    bits = np.zeros(1 << RANGE_BITS, bool)
    bits[offsets] = True
    return b"b" + np.packbits(bits).tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    """The bits of a packed bitmap, as booleans."""
    if packed[:1] == b"b":
        return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)).astype(bool)
    bits = np.zeros(1 << RANGE_BITS, bool)
    values = np.frombuffer(packed, "<u2", offset=1).astype(np.int64)
    if packed[:1] == b"a":
        bits[values] = True
    else:
        for a, b in values.reshape(2, -1).T:
            bits[a : b + 1] = True
    return bits


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["bits"] = [pack_bits(np.unique(x)) for x in pdf["bits"]]
        yield pdf


def _and_not(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one key range: the referenced keys of each period that don't exist throughout it."""
    loaded = np.zeros(1 << RANGE_BITS, bool)
    dropped = np.zeros(1 << RANGE_BITS, bool)
    out = []
    # within a period: what was deleted in it may be broken, what was loaded in it too
    for period, rows in pdf.sort_values("period").groupby("period", sort=True):
        for bits in rows.loc[rows["kind"] == _DROP, "bits"]:
            dropped |= unpack_bits(bits)
        for bits in rows.loc[rows["kind"] == _REF, "bits"]:
            left = np.flatnonzero(unpack_bits(bits) & ~(loaded & ~dropped))
            out.append(pd.DataFrame({"id": (int(pdf["range"].iloc[0]) << RANGE_BITS) + left, "period": period}))
        for bits in rows.loc[rows["kind"] == _LOAD, "bits"]:
            loaded |= unpack_bits(bits)
    return pd.concat(out) if out else pd.DataFrame({"id": np.empty(0, np.int64), "period": np.empty(0, np.int32)})


def month_number(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def key_dictionary(*keys: DataFrame) -> DataFrame:
    """(key, id) of all distinct keys: integers that are dense within each range of sorted keys."""
    both = keys[0]
    for k in keys[1:]:
        both = both.unionByName(k)
    ordered = both.where("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return materialize(ordered.select("key", F.monotonically_increasing_id().alias("id")))


def suspect_ids(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, period) of references whose key doesn't exist throughout the period, by bitmaps.

    ``pairs`` has (id, period), ``parents`` (id, first_seen, deleted_at); a null ``first_seen``
    means the key was always there.
    """
    always = F.lit(-1)
    events = F.array(
        F.struct(F.lit(_LOAD).alias("kind"), F.coalesce(month_number(F.col("first_seen")), always).alias("period")),
        F.struct(F.lit(_DROP).alias("kind"), month_number(F.col("deleted_at")).alias("period")),
    )
    told = parents.select("id", F.explode(events).alias("e")).select("id", "e.kind", "e.period").where("period is not null")
    rows = pairs.distinct().select("id", F.lit(_REF).alias("kind"), "period").unionByName(told)
    spread = rows.select(F.shiftright("id", RANGE_BITS).alias("range"), "kind", "period", F.col("id").bitwiseAND((1 << RANGE_BITS) - 1).cast("int").alias("off"))
    bitmaps = spread.groupBy("range", "kind", "period").agg(F.collect_set("off").alias("bits")).mapInPandas(_pack, "range long, kind int, period int, bits binary")
    return bitmaps.groupBy("range").applyInPandas(_and_not, "id long, period int")


def failed_references(refs: DataFrame, parents: DataFrame, at: str) -> DataFrame:
    """The rows of ``refs`` whose key fails at their own time, with ``reason`` and the month number ``period``.

    ``refs`` has ``key``, the time ``at`` and any other columns, which are kept; ``parents`` has
    (key, first_seen, deleted_at), one row per key. ``reason`` is ``missing`` if the key is no
    parent, else ``deleted`` if deleted_at <= at, else ``late`` if first_seen > at. References with
    a null key or time are no cases; repeated rows stay repeated. No parents: all are missing.

    Both tables are derived once and get their integers by one join on the key, the only one on
    strings; a hot key in it is split by the adaptive skew join. Later joins are on integers: a hot
    key's references spread over its periods, and pairs are distinct before they meet in a range.
    """
    kept = [c for c in refs.columns if c not in ("key", "period")]
    told = refs.where(F.col("key").isNotNull() & F.col(at).isNotNull()).select("key", month_number(F.col(at)).alias("period"), F.struct(*kept).alias("ref"))
    known = parents.where("key is not null").select("key", "first_seen", "deleted_at", F.lit(True).alias("known"))
    rows = materialize(told.unionByName(known, allowMissingColumns=True))
    rows = materialize(rows.join(key_dictionary(rows.select("key")), "key"))
    told, known = rows.where("known is null").select("id", "key", "period", "ref"), rows.where("known").select("id", "first_seen", "deleted_at", "known")
    suspects = suspect_ids(told.select("id", "period"), known).join(known, "id", "left")
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("deleted_at") <= F.col(f"ref.{at}"), "deleted").when(F.col("first_seen") > F.col(f"ref.{at}"), "late")
    found = told.join(suspects, ["id", "period"]).withColumn("reason", reason).where("reason is not null")
    return found.select("key", *[F.col(f"ref.`{c}`").alias(c) for c in kept], "period", "reason")


def orphan_report(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failed references counted per table, period and whatever else is asked for."""
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
