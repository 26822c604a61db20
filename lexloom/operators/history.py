"""History of changing attributes, from periodic snapshots.

Consecutive snapshots of a key are compared by a null-safe full outer join, which tells inserted,
changed and deleted keys apart; the change events are united and ``lead`` gives each state's end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(df: DataFrame, key: str, at: str, state: Sequence[str], carry: Sequence[str] = (), close_missing: bool = False) -> DataFrame:
    """Change events (key, at, change, state…) between consecutive snapshots.

    ``df`` has one row per (key, at); rows with a null key or date are ignored, repeated rows of
    one (key, at) count once (the greatest state). ``carry`` names state columns whose null means
    "not told": the value before goes on (null if none was told yet). ``change`` is ``inserted``,
    ``changed`` or ``deleted``. With ``close_missing`` a key that the next snapshot of all keys
    lacks is deleted on that date; else only snapshots that hold the key are compared, so that a
    missing snapshot ends nothing and no key is deleted. An empty table gives no events.

    Windows run per key over its distinct snapshot dates: bounded by the calendar, not by the rows.
    """
    one = (
        df.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(key).alias("_k"), F.col(at).alias("_at"))
        .agg(F.max(F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(state)])).alias("_s"))
    )
    by_key = Window.partitionBy("_k").orderBy("_at")
    told = [F.last(f"_s.s{i}", ignorenulls=True).over(by_key) if c in carry else F.col(f"_s.s{i}") for i, c in enumerate(state)]
    rows = one.select("_k", "_at", F.struct(*[t.alias(f"s{i}") for i, t in enumerate(told)]).alias("_s"), F.row_number().over(by_key).alias("_n"))
    if close_missing:
        dates = one.select("_at").distinct()
        calendar = dates.select("_at", F.row_number().over(Window.orderBy("_at")).alias("_n"), F.lead("_at").over(Window.orderBy("_at")).alias("_next"))
        rows = rows.drop("_n").join(calendar, "_at")
    else:
        rows = rows.withColumn("_next", F.lit(None).cast(df.schema[at].dataType))
    now = rows.select(F.col("_k").alias("k1"), F.col("_n").alias("n1"), F.col("_at").alias("at1"), F.col("_s").alias("s_new"))
    before = rows.select(F.col("_k").alias("k0"), (F.col("_n") + 1).alias("n0"), F.col("_next").alias("at0"), F.col("_s").alias("s_old"))
    both = now.join(before, F.col("k1").eqNullSafe(F.col("k0")) & F.col("n1").eqNullSafe(F.col("n0")), "full_outer")
    kind = F.when(F.col("k0").isNull(), "inserted").when(F.col("k1").isNull(), "deleted").when(~F.col("s_new").eqNullSafe(F.col("s_old")), "changed")
    events = both.select(
        F.coalesce("k1", "k0").alias(key), F.coalesce("at1", "at0").alias(at), kind.alias("change"),
        *[F.col(f"s_new.s{i}").alias(c) for i, c in enumerate(state)],
    )
    return events.where(F.col("change").isNotNull() & F.col(at).isNotNull())


def snapshot_history(df: DataFrame, key: str, at: str, state: Sequence[str], carry: Sequence[str] = (), close_missing: bool = False) -> DataFrame:
    """Periods (key, valid_from, valid_to, state…) in which a key's state stayed the same.

    ``valid_to`` is the start of the key's next event, null for the state still valid. See
    :func:`snapshot_changes` for nulls, repeats, carried values and deletions.
    """
    events = snapshot_changes(df, key, at, state, carry, close_missing)
    ends = events.withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(at)))
    return ends.where("change <> 'deleted'").select(key, F.col(at).alias("valid_from"), "valid_to", *state)
