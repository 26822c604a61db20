"""Version chains: neighbours, gaps, overlaps, as-of joins, change sets, statistics and integrity.

Versions are rows (law_uri, uri, start, end) with half-open validity and a null end while open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def by_law():
    """The versions of a law in order: a window bounded by one law's distinct versions."""
    return Window.partitionBy("law_uri").orderBy("start", "uri")


def version_chain(versions: DataFrame) -> DataFrame:
    """SUPERSEDES edges from each version to the one before it."""
    return versions.select("law_uri", F.col("uri").alias("newer_uri"), F.lag("uri").over(by_law()).alias("older_uri")).where("older_uri is not null")


def timeline(versions: DataFrame) -> DataFrame:
    """Each version with the one it supersedes and the one that supersedes it."""
    return versions.select("law_uri", "uri", "start", "end", F.lag("uri").over(by_law()).alias("supersedes"), F.lead("uri").over(by_law()).alias("superseded_by"))


def timeline_gaps(versions: DataFrame) -> DataFrame:
    """Neighbours between which no version is valid, with the days in true calendar distance."""
    nxt = versions.select("law_uri", "uri", "end", F.lead("start").over(by_law()).alias("next_start"), F.lead("uri").over(by_law()).alias("next_uri"))
    return nxt.where("end < next_start").select("law_uri", "uri", "next_uri", F.datediff("next_start", "end").alias("gap_days"))


def overlapping_versions(versions: DataFrame, bucket_years: int = 4) -> DataFrame:
    """Pairs of one law's versions of which the earlier is still valid when the later begins.

    The later version's start lies in one bucket of years, the earlier one spans a few: an equi-join
    on law and bucket replaces the comparison of all pairs of a law. An open end spans all buckets
    up to the last start of the law.
    """
    last = Window.partitionBy("law_uri")
    bucket = lambda c: F.floor(F.year(c) / bucket_years).cast("int")
    v = versions.where("start is not null").withColumn("last_bucket", F.max(bucket("start")).over(last))
    upto = F.greatest(bucket("start"), F.least(F.coalesce(bucket("end"), F.col("last_bucket")), F.col("last_bucket")))
    earlier = v.select("law_uri", F.col("uri").alias("uri1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.explode(F.sequence(bucket("start"), upto)).alias("b"))
    later = v.select("law_uri", F.col("uri").alias("uri2"), F.col("start").alias("start2"), bucket("start").alias("b"))
    return earlier.join(later, ["law_uri", "b"]).where("start1 < start2 and (end1 is null or end1 > start2)").select("law_uri", "uri1", "uri2")


def replaced_versions(versions: DataFrame) -> DataFrame:
    """REPLACES without its quadratic pairs: how many versions of the law began before each one."""
    older = Window.partitionBy("law_uri").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    days = versions.withColumn("day", F.unix_date(F.col("start").cast("date")))
    return days.select("law_uri", "uri", F.count("uri").over(older).alias("n_replaced"))


def valid_at(versions: DataFrame, at: Column) -> DataFrame:
    """The version of each law that is valid at a date; of several the one that began last."""
    hit = versions.where((F.col("start") <= at) & (F.col("end").isNull() | (F.col("end") > at)))
    return hit.groupBy("law_uri").agg(F.max(F.struct("start", "uri")).alias("v")).select("law_uri", F.col("v.uri").alias("uri"), F.col("v.start").alias("start"))


def as_of_join(events: DataFrame, versions: DataFrame, at: str) -> DataFrame:
    """Each event (law_uri, ``at``, …) with the version valid then: the last start not after it, if not ended.

    A version answers for the time up to the next start of its law, year by year (the last one up
    to the year of the last event): an equi-join on law and year, of which an event matches one row at
    most. Events of a hot law spread over years and may be split further as skew; only a law's
    versions, not its events, are ordered. Events with a null law or time keep a null version.
    """
    names = [c for c in events.columns if c not in ("law_uri", at)]
    horizon = events.agg(F.max(F.year(at))).head()[0] or 0
    until = F.lead("start").over(by_law())
    spans = versions.where("start is not null and law_uri is not null").select("law_uri", "uri", "start", "end", until.alias("until")).where("until is null or until > start")
    years = F.sequence(F.year("start"), F.greatest(F.year("start"), F.coalesce(F.year("until"), F.lit(horizon))))
    v = spans.select(F.col("law_uri").alias("_law"), F.explode(years).alias("_year"), F.col("uri").alias("_uri"), F.col("start").alias("_start"), F.col("until").alias("_until"), F.col("end").alias("_end"))
    t = F.col(at)
    match = (F.col("law_uri") == F.col("_law")) & (F.year(at) == F.col("_year")) & (F.col("_start") <= t) & (F.col("_until").isNull() | (F.col("_until") > t))
    joined = events.join(v, match, "left")
    return joined.select("law_uri", at, *names, F.when(F.col("_end").isNull() | (F.col("_end") > t), F.col("_uri")).alias("version_uri"))


def changes_between(versions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Versions that began or ended after ``start`` and not after ``end``."""
    within = lambda c: (F.col(c) > start) & (F.col(c) <= end)
    began = versions.where(within("start")).select("law_uri", "uri", F.col("start").alias("change_date"), F.lit("activated").alias("change_type"))
    ended = versions.where(within("end")).select("law_uri", "uri", F.col("end").alias("change_date"), F.lit("ended").alias("change_type"))
    return began.union(ended).distinct()


def boundaries(versions: DataFrame) -> DataFrame:
    return versions.groupBy("law_uri").agg(F.min("start").alias("earliest"), F.max(F.coalesce("end", "start")).alias("latest"))


def temporal_statistics(versions: DataFrame, now: Column) -> DataFrame:
    """Counts, open versions, versions with a predecessor, mean days (open ends count to ``now``) and completeness in percent."""
    rows = versions.withColumn("before", F.lag("uri").over(by_law()))
    n, linked = F.count(F.lit(1)), F.count("before")
    return rows.groupBy("law_uri").agg(
        n.alias("n_versions"), F.count_if(F.col("end").isNull()).alias("n_open"), linked.alias("with_predecessor"),
        F.avg(F.datediff(F.coalesce("end", now), "start")).alias("avg_days"), F.when(n > 1, linked * 100.0 / (n - 1)).otherwise(100.0).alias("completeness"),
    )


def chain_integrity(versions: DataFrame, min_year: int = 1848, max_years: int = 50) -> DataFrame:
    """Per law: versions out of order, implausible ranges, end-dated versions without successor."""
    rows = versions.withColumn("next_start", F.lead("start").over(by_law()))
    bad = (F.col("end") <= F.col("start")) | (F.year("start") < min_year) | (F.datediff("end", "start") > max_years * 365)
    return rows.groupBy("law_uri").agg(
        F.count_if(F.coalesce(bad, F.lit(False))).alias("bad_ranges"), F.count_if(F.col("next_start") == F.col("start")).alias("same_start"),
        F.count_if(F.col("end").isNotNull() & F.col("next_start").isNull()).alias("ended_without_successor"), F.count_if(F.col("end").isNull() & F.col("next_start").isNotNull()).alias("open_with_successor"),
    )


def parse_any_date(text: Column) -> Column:
    """A date written yyyy-MM-dd, with or without time, yyyy/MM/dd, dd.MM.yyyy or yyyyMMdd; else null."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_date(t, "yyyy/MM/dd"))
        .when(t.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(t, "dd.MM.yyyy"))
        .when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    )
