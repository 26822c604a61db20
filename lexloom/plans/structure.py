"""Queries on the inner structure of provisions: paragraphs, numbers, paths, checks, precedence of citing laws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.sr import normalize_sr
from lexloom.functions.text import ROMANS, numbered_paragraphs, sortable_number
from lexloom.functions.uris import article_number, law_designation
from lexloom.plans import catalogue as C
from lexloom.plans.problems import _designation, _number
from lexloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FIRST_YEAR, LONGEST_DAYS = 1848, 50 * 365
CITATIONS, DURATIONS = 5, 1000


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


_SUPER, _DIGITS = "¹²³⁴⁵⁶⁷⁸⁹⁰", "1234567890"
_PARTS = f"""p as (select uri, content_full as t, list_filter(string_split(regexp_replace(content_full, '(?m)^\\s*([{_SUPER}]+|\\d+)\\s+', chr(1) || '\\1' || chr(2), 'g'), chr(1)), lambda x: contains(x, chr(2))) as m from a where content_full is not null),
  q as (select uri, case when len(m) > 0 then list_transform(m, lambda x: {{'n': translate(split_part(x, chr(2), 1), '{_SUPER}', '{_DIGITS}'), 't': regexp_replace(split_part(x, chr(2), 2), '^\\s+|\\s+$', '', 'g')}})
    else [{{'n': '1', 't': regexp_replace(t, '^\\s+|\\s+$', '', 'g')}}] end as l from p)"""


@query(f"""with {C.ARTICLES}, {_PARTS}, i as (select uri, l, unnest(range(1, len(l) + 1)) as k from q)
select uri, k::int as position, l[k].n as paragraph_number, l[k].t as paragraph_text, l[k + 1].n as next_number from i""")
def paragraphs(s, d):
    """Paragraphs of the articles in order, each with its successor; the chain lies in one array, so nothing is shuffled for it."""
    parts = C.articles(s, d).where("content_full is not null").select("uri", numbered_paragraphs(F.col("content_full")).alias("l"))
    at = parts.select("uri", "l", F.posexplode("l").alias("i", "p"))
    return at.select("uri", (F.col("i") + 1).alias("position"), F.col("p.number").alias("paragraph_number"), F.col("p.text").alias("paragraph_text"), F.get("l", F.col("i") + 1)["number"].alias("next_number"))


@query(f"""with {C.ARTICLES} select uri, lang from a where regexp_matches(content_full, '(?i)(aufgehoben|abrogé|abrogato|abolì|repealed)')""")
def repealed_articles(s, d):
    """Articles whose text says that they were repealed."""
    return C.articles(s, d).where(F.col("content_full").rlike("(?iu)(aufgehoben|abrogé|abrogato|abolì|repealed)")).select("uri", "lang")


_ROMAN_SQL = "map {" + ", ".join(f"'{r}': '{n:03d}'" for n, r in ROMANS.items()) + "}"


@query(f"""with {C.ARTICLES}, x as (select uri, regexp_replace(lower(trim(number)), '^art\\.?\\s*', '') as n from a where number is not null)
select uri, case when regexp_matches(n, '^\\d') then repeat('0', greatest(3 - length(regexp_extract(n, '^\\d+', 0)), 0)) || n else coalesce({_ROMAN_SQL}[n], n) end as sort_key from x""")
def article_sort_keys(s, d):
    """Numbers padded to three digits, suffix kept, Roman ones as digits: they sort as the articles do."""
    return C.articles(s, d).where("number is not null").select("uri", sortable_number(F.col("number")).alias("sort_key"))


_SR = C.SR_SQL


@query(f"""with {C.ARTICLES}, {C.LAWS}, b as (select a.uri, a.ast_path, '/sr_' || replace({_SR}, '.', '_') || '/' || a.lang as parent_path, lower(trim(a.number)) as n from a join l using (law_uri) where a.number is not null and a.lang is not null)
select uri, parent_path, parent_path || '/art_' || n as built_path, coalesce(ast_path = parent_path || '/art_' || n, false) as agrees from b where parent_path is not null""")
def built_paths(s, d):
    """Path of each article from its law's number, language and number, beside the path that was delivered."""
    law = C.laws(s, d).select("law_uri", F.regexp_replace(normalize_sr(F.col("sr_number")), r"\.", "_").alias("sr")).where("sr is not null")
    a = C.articles(s, d).where("number is not null and lang is not null").select("uri", "law_uri", "lang", "number", "ast_path")
    b = a.join(law, "law_uri").withColumn("parent_path", F.concat(F.lit("/sr_"), "sr", F.lit("/"), "lang"))
    b = b.withColumn("built_path", F.concat("parent_path", F.lit("/art_"), F.lower(F.trim("number"))))
    return b.select("uri", "parent_path", "built_path", F.coalesce(F.col("ast_path") == F.col("built_path"), F.lit(False)).alias("agrees"))


@query(f"""with {C.VERSIONS}, x as (select uri, unnest([case when "end" <= start then 'end not after start' end, case when year(start) < {FIRST_YEAR} then 'too early' end,
  case when start > timestamp '2035-01-01' then 'too far ahead' end, case when date_diff('day', start::date, "end"::date) > {LONGEST_DAYS} then 'too long' end]) as issue from v) select * from x where issue is not null""")
def date_range_issues(s, d):
    """Versions whose dates cannot be right."""
    start, end = F.col("start"), F.col("end")
    issues = F.array_compact(F.array(
        F.when(end <= start, "end not after start"), F.when(F.year(start) < FIRST_YEAR, "too early"),
        F.when(start > F.expr("timestamp_ntz'2035-01-01 00:00:00'"), "too far ahead"), F.when(F.datediff(end, start) > LONGEST_DAYS, "too long"),
    ))
    return C.versions(s, d).select("uri", F.explode(issues).alias("issue"))


@query(f"""with {C.ARTICLES}, {C.LAWS}, u as (select distinct law_uri from l), x as (select unnest(list_filter([case when u.law_uri is null then 'law' end, case when a.ast_path is null or a.ast_path = '' then 'path' end, case when a.variant is null then 'variant' end], lambda y: y is not null)) as missing
  from a left join u on a.law_uri = u.law_uri) select missing, count(*) as n_articles from x group by 1""")
def incomplete_articles(s, d):
    """What articles lack of their place in the tree: a law that exists, a path, a variant."""
    known = C.laws(s, d).select("law_uri", F.lit(True).alias("known"))
    a = C.articles(s, d).select("law_uri", "ast_path", "variant").join(known, "law_uri", "left")
    lacks = F.array_compact(F.array(F.when(F.col("known").isNull(), "law"), F.when(F.coalesce(F.col("ast_path"), F.lit("")) == "", "path"), F.when(F.col("variant").isNull(), "variant")))
    return a.select(F.explode(lacks).alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("n_articles"))


@query("""with x as (select regexp_extract(file_path, '^(/[^/]+/[^/]+/[^/]+)/', 1) as folder, file_path, payload from fedlex_json)
select folder, count(distinct file_path) as n_files, count(*) as n_deliveries, sum(length(payload))::bigint as n_chars, max(length(payload))::bigint as longest, count(*) filter (payload is null or payload = '') as n_empty from x group by 1""")
def payload_statistics(s, d):
    """Files, deliveries and sizes per folder."""
    p = table(s, d, "fedlex_json").select(F.regexp_extract("file_path", "^(/[^/]+/[^/]+/[^/]+)/", 1).alias("folder"), "file_path", F.length("payload").cast("long").alias("n"))
    p = p.groupBy("folder", "file_path").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.max("n").alias("longest"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("e"))
    return p.groupBy("folder").agg(F.count("file_path").alias("n_files"), F.sum("c").alias("n_deliveries"), F.sum("n").alias("n_chars"), F.max("longest").alias("longest"), F.sum("e").alias("n_empty"))


@query(f"""with {C.REFS}, x as (select distinct source_law, {_designation('target_law')} as target, {_number('target_article')} as article from r where source_law is not null and {_designation('target_law')} is not null),
  k as (select *, row_number() over (partition by source_law order by article is null, target, article) as rank from x) select source_law, target, article, rank::int as rank from k where rank <= {CITATIONS}""")
def ranked_citations(s, d):
    """The first citations of each law, those of an article before others; the limit per law is the report's."""
    r = C.references(s, d).select("source_law", law_designation(F.col("target_law")).alias("target"), article_number(F.col("target_article")).alias("article"))
    r = r.where("source_law is not null and target is not null").distinct()
    order = Window.partitionBy("source_law").orderBy(F.col("article").isNull(), "target", "article")
    return r.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CITATIONS)


_RANK = "case when sr like '101%' then 1 when sr like '210%' or sr like '220%' then 2 when sr like '235%' then 3 else 4 end"


@query(f"""with {C.LAWREFS}, {C.VERSIONS}, st as (select law_uri, max(start) as newest from v group by 1), f as (select l.law_uri, coalesce({_SR}, '') as sr, coalesce(newest, timestamp '0001-01-01') as newest from l left join st using (law_uri)),
  x as (select lr.dst as target, f.law_uri, {_RANK} as rank, newest, length(sr) as n from lr join f on lr.src = f.law_uri)
select target, min({{'k': rank, 'law': law_uri}}).law as superior, max({{'k': newest, 'law': law_uri}}).law as posterior, max({{'k': n, 'law': law_uri}}).law as specialis, count(*) as n_laws from x group by 1""")
def precedence(s, d):
    """Of the laws that refer to one law: the highest, the newest and the most special, ties by URI; aggregates that combine before the shuffle."""
    newest = C.versions(s, d).groupBy("law_uri").agg(F.max("start").alias("newest"))
    sr = F.coalesce(normalize_sr(F.col("sr_number")), F.lit(""))
    f = C.laws(s, d).select("law_uri", sr.alias("sr")).join(newest, "law_uri", "left")
    rank = F.when(F.col("sr").like("101%"), 1).when(F.col("sr").like("210%") | F.col("sr").like("220%"), 2).when(F.col("sr").like("235%"), 3).otherwise(4)
    f = f.select("law_uri", rank.alias("rank"), F.coalesce("newest", F.expr("timestamp_ntz'0001-01-01 00:00:00'")).alias("newest"), F.length("sr").alias("n"))
    x = C.law_references(s, d).select(F.col("dst").alias("target"), F.col("src").alias("law_uri")).join(f, "law_uri")
    best = lambda pick, key: pick(F.struct(key, "law_uri"))["law_uri"]
    return x.groupBy("target").agg(best(F.min, "rank").alias("superior"), best(F.max, "newest").alias("posterior"), best(F.max, "n").alias("specialis"), F.count(F.lit(1)).alias("n_laws"))


@query(f"""with x as (select event_type as stage, value, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events where value is not null)
select stage, count(*) as n_kept, round(avg(value), 4) as avg_value, max(value) as max_value from x where k <= {DURATIONS} group by 1""")
def recent_durations(s, d):
    """Rolling history: the newest values of each stage; Spark cuts each group in every task before the shuffle."""
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(s, d, "events").where("value is not null").withColumn("k", F.row_number().over(newest))
    return e.where(F.col("k") <= DURATIONS).groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.avg("value"), 4).alias("avg_value"), F.max("value").alias("max_value"))
