"""Latest delivery of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_delivery(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the row with the greatest ``order``, whole.

    Pre-aggregates on the map side, so repeated rows of a hot key never meet in one task.
    Ties in ``order`` go to the greatest values, so the result doesn't depend on row order. A null
    ``order`` counts as earliest. Rows with a null key form a key of their own.
    """
    last = df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_order"), *[F.col(v) for v in values])).alias("_last"))
    return last.select(*keys, F.col("_last._order").alias(order), *[F.col(f"_last.{v}").alias(v) for v in values])
