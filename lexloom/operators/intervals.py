"""Continuous periods and gaps of overlapping, nested or separated intervals.

Integer intervals are decomposed into canonical dyadic blocks, in Spark; equal blocks of a key are
aggregated before any row is gathered by key, so what a key gathers is bounded by the length of
the axis, not by its rows. Then, many keys at a time, blocks inside an ancestor are removed,
sibling pairs merge upward, and adjacent blocks coalesce.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The axis is [0, 2**LEVELS): days from 0001-01-01 to 9999-12-31 fit.
LEVELS = 22
#: Day number of 1970-01-01 when 0001-01-01 is day 0, and of 9999-12-31.
EPOCH_DAY, LAST_DAY = 719162, 3652058


def dyadic_blocks(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Distinct canonical blocks (keys…, level, idx) of the intervals [start, end).

    A block covers [idx << level, (idx + 1) << level). Intervals with a null bound or end <= start
    and rows with a null key give no block; bounds beyond the axis are cut to it.
    """
    a = F.greatest(F.col(start).cast("int"), F.lit(0))
    b = F.least(F.col(end).cast("int"), F.lit(1 << LEVELS))
    picked = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, a.alias("_a"), b.alias("_b"))
    picked = picked.where("_a < _b").dropna(subset=list(keys))

    blocks = F.expr(
        f"""flatten(transform(sequence(0, least({LEVELS}, cast(log2(_b - _a) as int))), k -> filter(array(
            if(shiftright(_a + shiftleft(1, k) - 1, k) % 2 = 1, struct(k as level, shiftright(_a + shiftleft(1, k) - 1, k) as idx), null),
            if(shiftright(_b, k) % 2 = 1, struct(k as level, shiftright(_b, k) - 1 as idx), null)
        ), x -> x is not null and shiftright(_a + shiftleft(1, k) - 1, k) < shiftright(_b, k))))"""
    )
    return picked.select(*keys, F.explode(blocks).alias("_x")).select(*keys, "_x.level", "_x.idx").distinct()


def _coalesce(gid: np.ndarray, level: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans (gid, start, end) of the blocks; gid ascends from 0."""
    shift = LEVELS + 1
    start = idx << level
    end = start + (np.int64(1) << level)
    order = np.lexsort((-level, start, gid))
    gid, level, idx, far = gid[order], level[order], idx[order], (gid[order] << shift) + end[order]
    reach = np.maximum.accumulate(far)
    free = np.ones(len(gid), bool)
    free[1:] = reach[:-1] < far[1:]
    gid, level, idx = gid[free], level[free], idx[free]

    starts, ends, up = [], [], np.empty(0, np.int64)
    for k in range(LEVELS + 1):
        at = np.sort(np.concatenate([up, (gid[level == k] << shift) + idx[level == k]]))
        pair = np.zeros(len(at), bool)
        if k < LEVELS and len(at) > 1:
            pair[:-1] = (at[:-1] % 2 == 0) & (at[1:] == at[:-1] + 1)
        second = np.zeros(len(at), bool)
        second[1:] = pair[:-1]
        low = at[pair]
        up = (low >> shift << shift) + ((low & ((1 << shift) - 1)) >> 1)
        stay = at[~pair & ~second]
        g, i = stay >> shift << shift, stay & ((1 << shift) - 1)
        starts.append(g + (i << k))
        ends.append(g + ((i + 1) << k))
    s, e = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(s)
    s, e = s[order], e[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != e[:-1]) | (s[1:] >> shift != s[:-1] >> shift)
    last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    mask = (1 << shift) - 1
    g = s[new] >> shift
    return g, s[new] & mask, e[last] - (g << shift)


def _spans(keys: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Periods and gaps of the keys of a partition that is sorted by key; holds whole keys only as long as needed."""
    held: list[pd.DataFrame] = []

    def flush(pdf: pd.DataFrame) -> pd.DataFrame:
        new = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy()
        gid = np.cumsum(new) - 1
        g, s, e = _coalesce(gid.astype(np.int64), pdf["level"].to_numpy(np.int64), pdf["idx"].to_numpy(np.int64))
        gap = np.flatnonzero(g[1:] == g[:-1])
        names = pdf[keys][new].reset_index(drop=True)
        out = names.iloc[np.concatenate([g, g[gap]])].reset_index(drop=True)
        out["span_kind"] = ["period"] * len(g) + ["gap"] * len(gap)
        out["from_day"] = np.concatenate([s, e[gap]]).astype(np.int32)
        out["to_day"] = np.concatenate([e, s[gap + 1]]).astype(np.int32)
        return out

    for pdf in batches:
        if pdf.empty:
            continue
        first = pdf.iloc[-1][keys]
        whole = ~(pdf[keys] == first).all(axis=1).to_numpy()
        cut = len(pdf) - int(np.argmax(whole[::-1])) if whole.any() else 0
        if cut or (held and not (held[-1].iloc[-1][keys] == first).all()):
            yield flush(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield flush(pd.concat(held, ignore_index=True))


def covered_spans(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Per key the maximal covered spans (``period``) and what lies between two of them (``gap``).

    Returns (keys…, span_kind, from_day, to_day) with half-open spans on the integer axis. Spans
    that touch are one period. See :func:`dyadic_blocks` for nulls and empty intervals; an empty
    table gives no rows; other columns of ``df``, whatever their names, are ignored.
    """
    keys = list(keys)
    blocks = dyadic_blocks(df, keys, start, end)
    types = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    ordered = blocks.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInPandas(lambda it: _spans(keys, it), f"{types}, span_kind string, from_day int, to_day int")


def day_number(date: Column) -> Column:
    """Days since 0001-01-01 of a date or timestamp, without its time of day."""
    return F.unix_date(date.cast("date")) + EPOCH_DAY


def day_string(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day - EPOCH_DAY), "yyyy-MM-dd")
