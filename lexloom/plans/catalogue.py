"""Queries of the legal graph engine over the law collection, each with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import questions as Q
from lexloom.functions.sr import is_valid_sr, normalize_sr, sr_domain, sr_levels
from lexloom.functions.text import LANGUAGE_WORDS, detect_language, truncate_words, word_count
from lexloom.functions.uris import article_number, canonical_uri, law_designation, law_of_uri, status_digit
from lexloom.operators import graph as G
from lexloom.operators import retrieval as R
from lexloom.operators import temporal as T
from lexloom.operators.dedup import latest_delivery
from lexloom.plans.problems import _designation, _law, _number, _uri
from lexloom.session import dealt, materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "timestamp_ntz'2025-01-01 00:00:00'"
WORDS = ["frist", "gericht", "article", "gebühren"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- shared views: latest deliveries with canonical keys ----

def versions(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "version_nodes").select(canonical_uri(F.col("uri")).alias("uri"), canonical_uri(F.col("law_uri")).alias("law_uri"), F.col("date_applicable").alias("start"), F.when(F.year("date_end_applicable") < 9999, F.col("date_end_applicable")).alias("end"), "loaded_at")
    return latest_delivery(raw.where("uri is not null"), ["uri"], "loaded_at", ["law_uri", "start", "end"]).where("law_uri is not null and start is not null").drop("loaded_at")


LAW_COLUMNS = ["sr_number", "title_de", "title_fr", "title_it", "title_en", "date_document", "date_entry_in_force", "date_no_longer_in_force", "in_force", "in_force_status", "ast_path", "deleted_at"]


def laws(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "law_nodes").withColumn("law_uri", canonical_uri(F.col("uri"))).where("law_uri is not null")
    return latest_delivery(raw, ["law_uri"], "loaded_at", LAW_COLUMNS)


ARTICLE_COLUMNS = ["law_uri", "variant", "lang", "number", "number_normalized", "title", "ast_path", "art_position", "content_full"]


def articles(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "article_nodes").withColumns({"uri": canonical_uri(F.col("uri")), "law_uri": canonical_uri(F.col("law_uri")), "variant": canonical_uri(F.col("law_language_variant_uri"))}).where("uri is not null")
    return latest_delivery(raw, ["uri"], "loaded_at", ARTICLE_COLUMNS)


def levels(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "taxonomy_levels").withColumns({"uri": canonical_uri(F.col("uri")), "parent_uri": canonical_uri(F.col("parent_uri")), "law_uri": canonical_uri(F.col("law_uri"))}).where("uri is not null")
    return latest_delivery(raw, ["uri"], "loaded_at", ["parent_uri", "level_type", "number", "level_name", "title_de", "title_fr", "title_it", "law_uri"])


def variants(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "law_language_variants").withColumns({"uri": canonical_uri(F.col("uri")), "law_uri": canonical_uri(F.col("law_uri"))}).where("uri is not null")
    return latest_delivery(raw, ["uri"], "loaded_at", ["law_uri", "lang", "title", "ast_path", "deleted_at"])


def references(s: SparkSession, d: str) -> DataFrame:
    raw = dealt(table(s, d, "html_references")).select("ref_id", law_of_uri(canonical_uri(F.col("source_uri"))).alias("source_law"), "target_law", "target_article", "raw_text", "lang", "confidence", "context_text", "extracted_at", "source_file")
    return raw.dropDuplicates(["ref_id"])


def law_names(s: SparkSession, d: str) -> DataFrame:
    """(name, target): every name of a law, its URI, number or abbreviation, with the law's URI; of several laws of one name the first."""
    l = laws(s, d)
    own = l.select(law_designation(F.col("sr_number")).alias("name"), F.col("law_uri").alias("target")).unionByName(l.select(F.col("law_uri").alias("name"), F.col("law_uri").alias("target")))
    c = table(s, d, "code_articles").select(law_of_uri(canonical_uri(F.col("law_uri"))).alias("target"), F.explode(F.array(law_designation(F.col("sr_number")), law_designation(F.col("abbreviation")), law_of_uri(canonical_uri(F.col("law_uri"))))).alias("name"))
    return own.unionByName(c.distinct()).where("name is not null and target is not null").groupBy("name").agg(F.min("target").alias("target"))


def named_references(s: SparkSession, d: str) -> DataFrame:
    """(src, name, n): which law refers to which name, and how often; counted before any join, so that a hot name meets as few rows as there are laws."""
    raw = dealt(table(s, d, "html_references").select("ref_id", "source_uri", "target_law")).select("ref_id", law_of_uri(canonical_uri(F.col("source_uri"))).alias("src"), law_designation(F.col("target_law")).alias("name"))
    return raw.where("src is not null and name is not null").groupBy("src", "name").agg(F.count_distinct("ref_id").alias("n"))


def law_references(s: SparkSession, d: str) -> DataFrame:
    """Distinct REFERENCES edges between laws: targets named by number or abbreviation count by the law's URI; an unknown number or abbreviation is no node, an unknown URI is."""
    r = named_references(s, d).join(law_names(s, d), "name", "left").withColumn("dst", F.coalesce("target", F.when(F.col("name").startswith("https:"), F.col("name"))))
    return r.where("dst is not null and src <> dst").select("src", "dst", F.lit("REFERENCES").alias("type")).distinct()


def law_edges(s: SparkSession, d: str, refs: DataFrame | None = None) -> DataFrame:
    v = versions(s, d).select(F.col("law_uri").alias("src"), F.col("uri").alias("dst"), F.lit("HAS_VERSION").alias("type"))
    l = variants(s, d).select(F.col("law_uri").alias("src"), F.col("uri").alias("dst"), F.lit("HAS_LANGUAGE").alias("type")).where("src is not null")
    return v.unionByName(l).unionByName(refs or law_references(s, d))


def _last(name: str, tab: str, key: str, cols: dict[str, str]) -> str:
    order = ", ".join(f"{c} desc nulls last" for c in cols)
    return f"""{name} as (select * exclude (rn) from (select *, row_number() over (partition by {key} order by loaded_at desc, {order}) as rn
        from (select {', '.join(f'{e} as {c}' for c, e in cols.items())}, {_uri('uri')} as {key}, loaded_at from {tab}) where {key} is not null) where rn = 1)"""


SR_SQL = "regexp_replace(nullif(regexp_replace(regexp_replace(sr_number, '\\s+', '', 'g'), '^(?i)(SR|RS)', ''), ''), '(^|\\.)0+(\\d)', '\\1\\2', 'g')"
VERSIONS = _last("v0", "version_nodes", "uri", {"law_uri": _uri("law_uri"), "start": "date_applicable", "\"end\"": "case when year(date_end_applicable) < 9999 then date_end_applicable end"}) + ", v as (select * from v0 where law_uri is not null and start is not null)"
LAWS = _last("l", "law_nodes", "law_uri", {c: c for c in LAW_COLUMNS})
ARTICLES = _last("a", "article_nodes", "uri", {"law_uri": _uri("law_uri"), "variant": _uri("law_language_variant_uri"), **{c: c for c in ARTICLE_COLUMNS[2:]}})
LEVELS = _last("t", "taxonomy_levels", "uri", {"parent_uri": _uri("parent_uri"), "level_type": "level_type", "number": "number", "level_name": "level_name", "title_de": "title_de", "title_fr": "title_fr", "title_it": "title_it", "law_uri": _uri("law_uri")})
VARIANTS = _last("g", "law_language_variants", "uri", {"law_uri": _uri("law_uri"), "lang": "lang", "title": "title", "ast_path": "ast_path", "deleted_at": "deleted_at"})
REFS = f"r as (select distinct on (ref_id) ref_id, {_law('source_uri')} as source_law, target_law, target_article, raw_text, lang, confidence, context_text, extracted_at, source_file from html_references)"
LAWNAMES = f"""nl as (select {_designation('sr_number')} as name, law_uri as target from l union all select law_uri, law_uri from l
    union all select {_designation('sr_number')}, {_law('law_uri')} from code_articles union all select {_designation('abbreviation')}, {_law('law_uri')} from code_articles union all select {_law('law_uri')}, {_law('law_uri')} from code_articles),
  names as (select name, min(target) as target from nl where name is not null and target is not null group by 1)"""
LAWREFS = f"""{LAWS}, {LAWNAMES}, {REFS}, rd as (select distinct source_law as src, {_designation('target_law')} as name from r where source_law is not null),
  rr as (select src, coalesce(target, case when rd.name like 'https:%' then rd.name end) as dst from rd left join names using (name)), lr as (select distinct src, dst, 'REFERENCES' as type from rr where dst is not null and src <> dst)"""
EDGES = f"{VERSIONS}, {VARIANTS}, {LAWREFS}, e as (select law_uri as src, uri as dst, 'HAS_VERSION' as type from v union all select law_uri, uri, 'HAS_LANGUAGE' from g where law_uri is not null union all select * from lr)"


# ---- temporal ----

@query(f"with {VERSIONS} select law_uri, uri as newer_uri, lag(uri) over w as older_uri from v window w as (partition by law_uri order by start, uri) qualify older_uri is not null")
def version_chain(s, d):
    return T.version_chain(versions(s, d))


@query(f"with {VERSIONS} select law_uri, uri, start, \"end\", lag(uri) over w as supersedes, lead(uri) over w as superseded_by from v window w as (partition by law_uri order by start, uri)")
def version_timeline(s, d):
    return T.timeline(versions(s, d))


@query(f"""with {VERSIONS}, n as (select law_uri, uri, "end" as e, lead(start) over w as ns, lead(uri) over w as next_uri from v window w as (partition by law_uri order by start, uri))
select law_uri, uri, next_uri, datediff('day', e, ns)::int as gap_days from n where e < ns""")
def timeline_gaps(s, d):
    return T.timeline_gaps(versions(s, d))


@query(f"""with {VERSIONS} select a.law_uri, a.uri as uri1, b.uri as uri2 from v a join v b on a.law_uri = b.law_uri and a.start < b.start and (a."end" is null or a."end" > b.start)""")
def version_overlaps(s, d):
    return T.overlapping_versions(versions(s, d))


@query(f"with {VERSIONS} select a.law_uri, a.uri, count(b.uri) as n_replaced from v a left join v b on a.law_uri = b.law_uri and b.start::date < a.start::date group by 1, 2")
def replaced_versions(s, d):
    return T.replaced_versions(versions(s, d))


@query(f"""with {VERSIONS} select law_uri, arg_max(uri, (start, uri)) as uri, max(start) as start from v where start <= timestamp '2010-06-15' and ("end" is null or "end" > timestamp '2010-06-15') group by 1""")
def version_at_date(s, d):
    return T.valid_at(versions(s, d), F.expr("timestamp_ntz'2010-06-15 00:00:00'"))


@query(f"""with {VERSIONS}, {REFS}, q as (select ref_id, source_law as law_uri, extracted_at from r where source_law is not null),
  j as (select q.*, v.uri, v."end" as e, row_number() over (partition by ref_id order by v.start desc nulls last, v.uri desc nulls last) as rn from q left join v on q.law_uri = v.law_uri and v.start <= q.extracted_at)
select law_uri, ref_id, extracted_at, case when e is null or e > extracted_at then uri end as version_uri from j where rn = 1""")
def reference_versions(s, d):
    """As-of join: the version of the citing law that was valid when each reference was extracted."""
    r = references(s, d).where("source_law is not null").select(F.col("source_law").alias("law_uri"), "ref_id", "extracted_at")
    return T.as_of_join(r, versions(s, d), "extracted_at")


@query(f"""with {VERSIONS} select law_uri, uri, start as change_date, 'activated' as change_type from v where start > timestamp '2005-01-01' and start <= timestamp '2007-12-31'
union select law_uri, uri, "end", 'ended' from v where "end" > timestamp '2005-01-01' and "end" <= timestamp '2007-12-31'""")
def changes_between(s, d):
    return T.changes_between(versions(s, d), F.expr("timestamp_ntz'2005-01-01 00:00:00'"), F.expr("timestamp_ntz'2007-12-31 00:00:00'"))


@query(f"""with {VERSIONS} select law_uri, min(start) as earliest, max(coalesce("end", start)) as latest from v group by 1""")
def version_boundaries(s, d):
    return T.boundaries(versions(s, d))


@query(f"""with {VERSIONS}, b as (select *, lag(uri) over (partition by law_uri order by start, uri) as prev from v)
select law_uri, count(*) as n_versions, count(*) filter ("end" is null) as n_open, count(prev) as with_predecessor, round(avg(datediff('day', start, coalesce("end", timestamp '2025-01-01'))), 6) as avg_days,
  case when count(*) > 1 then round(count(prev) * 100.0 / (count(*) - 1), 6) else 100.0 end::double as completeness from b group by 1""")
def temporal_stats(s, d):
    st = T.temporal_statistics(versions(s, d), F.expr(NOW))
    return st.withColumns({"avg_days": F.round("avg_days", 6), "completeness": F.round(F.col("completeness").cast("double"), 6)})


@query(f"""with {VERSIONS}, b as (select *, lead(start) over (partition by law_uri order by start, uri) as ns from v)
select law_uri, count(*) filter ("end" <= start or year(start) < 1848 or datediff('day', start, "end") > 18250) as bad_ranges, count(*) filter (ns = start) as same_start,
  count(*) filter ("end" is not null and ns is null) as ended_without_successor, count(*) filter ("end" is null and ns is not null) as open_with_successor from b group by 1""")
def chain_integrity(s, d):
    return T.chain_integrity(versions(s, d))


@query(f"""with {VERSIONS} select (select count(distinct law_uri) from v)::bigint as laws_with_versions, (select count(*) from v)::bigint as n_versions, count(*)::bigint as n_supersedes
from (select lag(uri) over (partition by law_uri order by start, uri) as o from v) where o is not null""")
def chain_statistics(s, d):
    v = versions(s, d).withColumn("o", F.lag("uri").over(T.by_law()))
    return v.agg(F.countDistinct("law_uri").alias("laws_with_versions"), F.count(F.lit(1)).alias("n_versions"), F.count("o").alias("n_supersedes"))


@query(f"""with {LAWS} select law_uri, strftime(case when regexp_matches(date_document, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_strptime(left(date_document, 10), '%Y-%m-%d')
  when regexp_matches(date_document, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}$') then try_strptime(date_document, '%d.%m.%Y') when regexp_matches(date_document, '^\\d{{8}}$') then try_strptime(date_document, '%Y%m%d')
  when regexp_matches(date_document, '^\\d{{4}}/\\d{{2}}/\\d{{2}}$') then try_strptime(date_document, '%Y/%m/%d') end, '%Y-%m-%d') as document_date from l""")
def law_dates(s, d):
    return laws(s, d).select("law_uri", F.date_format(T.parse_any_date(F.col("date_document")), "yyyy-MM-dd").alias("document_date"))


# ---- projections and predicates ----

_NUR = "'nur ital.', 'nur franz.', 'nur deutsch', 'nur rom.'"


def _real_title(c: str):
    low = F.lower(F.trim(c))
    return F.when(~low.startswith("nur ") & (low != ""), F.trim(c))


def _sql_title(c: str) -> str:
    return f"case when {c} is not null and not starts_with(lower(trim({c})), 'nur ') and trim({c}) <> '' then trim({c}) end"


@query(f"""with {LAWS} select law_uri, coalesce({_sql_title('title_de')}, {_sql_title('title_fr')}, {_sql_title('title_it')}, {_sql_title('title_en')}, 'SR ' || sr_number, law_uri) as display_title,
  case when {_sql_title('title_de')} is not null then 'de' when {_sql_title('title_fr')} is not null then 'fr' when {_sql_title('title_it')} is not null then 'it' when {_sql_title('title_en')} is not null then 'en' end as primary_language from l""")
def display_titles(s, d):
    titles = {c[-2:]: _real_title(c) for c in ("title_de", "title_fr", "title_it", "title_en")}
    lang = F.coalesce(*[F.when(t.isNotNull(), k) for k, t in titles.items()])
    return laws(s, d).select("law_uri", F.coalesce(*titles.values(), F.concat(F.lit("SR "), "sr_number"), "law_uri").alias("display_title"), lang.alias("primary_language"))


@query(f"""with {LAWS} select law_uri, case when date_no_longer_in_force is not null and date_no_longer_in_force <> '' then false when st in ('0', '1', '2') then true when st = '3' then false else true end as in_force_now,
  case st when '0' then 'in_force' when '1' then 'partially_in_force' when '2' then 'not_yet_in_force' when '3' then 'repealed' else 'unknown' end as status
from (select *, nullif(regexp_extract(in_force_status, '(\\d)/?\\s*$', 1), '') as st from l)""")
def in_force_states(s, d):
    st = status_digit(F.col("in_force_status"))
    gone = F.col("date_no_longer_in_force").isNotNull() & (F.col("date_no_longer_in_force") != "")
    names = F.create_map(*[F.lit(x) for x in ("0", "in_force", "1", "partially_in_force", "2", "not_yet_in_force", "3", "repealed")])
    return laws(s, d).select("law_uri", F.when(gone, False).otherwise(~F.coalesce(st == "3", F.lit(False))).alias("in_force_now"), F.coalesce(F.when(st.isNotNull(), F.try_element_at(names, st)), F.lit("unknown")).alias("status"))


@query(f"""with {LAWS}, n as (select law_uri, regexp_replace(regexp_replace(regexp_replace(sr_number, '\\s+', '', 'g'), '^(?i)(SR|RS)', ''), '(^|\\.)0+(\\d)', '\\1\\2', 'g') as sr from l)
select law_uri, nullif(sr, '') as sr, coalesce(regexp_matches(nullif(sr, ''), '^\\d{{1,3}}(\\.\\d{{1,4}}){{0,4}}$'), false) as valid_sr from n""")
def sr_numbers(s, d):
    sr = normalize_sr(F.col("sr_number"))
    return laws(s, d).select("law_uri", sr.alias("sr"), is_valid_sr(sr).alias("valid_sr"))


@query(f"""with {LAWS}, n as (select distinct regexp_replace(regexp_replace(sr_number, '\\s+', '', 'g'), '^(?i)(SR|RS)', '') as sr from l where sr_number is not null),
  p as (select split_part(sr, '.', 1) as a, split_part(sr, '.', 2) as b from n where sr <> ''),
  x as (select 'domain' as level, 'sr://domain/' || a[1] as level_uri, null::varchar as parent_uri from p union select 'book', 'sr://domain/' || a[1] || '/book/' || a[1:2], 'sr://domain/' || a[1] from p where length(a) >= 2
    union select 'chapter', 'sr://domain/' || a[1] || '/book/' || a[1:2] || '/chapter/' || a, 'sr://domain/' || a[1] || '/book/' || a[1:2] from p where length(a) >= 3
    union select 'section', 'sr://domain/' || a[1] || '/book/' || a[1:2] || '/chapter/' || a || '/section/' || b, 'sr://domain/' || a[1] || '/book/' || a[1:2] || '/chapter/' || a from p where length(a) >= 3 and b <> '')
select * from x""")
def sr_taxonomy(s, d):
    rows = laws(s, d).select(F.explode(sr_levels(normalize_sr(F.col("sr_number")))).alias("x"))
    return rows.select("x.level", "x.level_uri", "x.parent_uri").distinct()


@query(f"with {LAWS} select left(regexp_replace(regexp_replace(sr_number, '\\s+', '', 'g'), '^(?i)(SR|RS)', ''), 1) as domain, count(*) as n_laws from l where sr_number is not null and trim(sr_number) <> '' group by 1")
def laws_by_domain(s, d):
    sr = normalize_sr(F.col("sr_number"))
    named = laws(s, d).where(sr.isNotNull()).select(F.substring(sr, 1, 1).alias("domain"), sr_domain(sr).alias("name"))
    return named.groupBy("domain").agg(F.count(F.lit(1)).alias("n_laws"))


@query(f"""with u as (select distinct {_uri('target_law')} as uri from html_references where {_uri('target_law')} like 'https:%')
select uri, coalesce(nullif(regexp_extract(uri, '^(https://[^/]+/eli/cc/[^/]+/[^/]+)', 1), ''), uri) as law, nullif(regexp_extract(uri, '/(\\d{{8}})(/|$)', 1), '') as version_date, nullif(regexp_extract(uri, '/(de|fr|it|rm|en)(/|$)', 1), '') as lang,
  nullif(regexp_extract(uri, '/(html|pdf|xml|docx|json)$', 1), '') as format, regexp_matches(uri, '/\\d{{8}}(/|$)') as is_version from u""")
def uri_parts(s, d):
    u = canonical_uri(F.col("target_law"))
    part = lambda p: F.nullif(F.regexp_extract("uri", p, 1), F.lit(""))
    rows = table(s, d, "html_references").select(u.alias("uri")).where("uri like 'https:%'").distinct()
    return rows.select("uri", law_of_uri(F.col("uri")).alias("law"), part(r"/(\d{8})(/|$)").alias("version_date"), part(r"/(de|fr|it|rm|en)(/|$)").alias("lang"), part(r"/(html|pdf|xml|docx|json)$").alias("format"), F.col("uri").rlike(r"/\d{8}(/|$)").alias("is_version"))


@query(f"""with {ARTICLES} select uri, case when n between 319 and 362 then 'employment' when n between 253 and 304 then 'rental' when n between 312 and 318 then 'credit' else 'other' end as topic
from (select uri, try_cast(regexp_extract(number, '^\\s*(\\d+)', 1) as int) as n from a)""")
def article_topics(s, d):
    n = F.regexp_extract("number", r"^\s*(\d+)", 1).try_cast("int")
    return articles(s, d).select("uri", F.when(n.between(319, 362), "employment").when(n.between(253, 304), "rental").when(n.between(312, 318), "credit").otherwise("other").alias("topic"))


@query(f"""with {ARTICLES} select uri, length(content_full) as n_chars, case when content_full is null or trim(content_full) = '' then 0 else len(string_split_regex(trim(content_full), '\\s+')) end::int as n_words, left(content_full, 500) as content_preview from a""")
def article_sizes(s, d):
    return articles(s, d).select("uri", F.length("content_full").cast("long").alias("n_chars"), word_count(F.col("content_full")).alias("n_words"), F.substring("content_full", 1, 500).alias("content_preview"))


@query(f"""with {ARTICLES} select uri, case when length(content_full) <= 80 then content_full else regexp_replace(left(content_full, 80), ' [^ ]*$', '') || '...' end as short_text from a where content_full is not null""")
def truncated_articles(s, d):
    return articles(s, d).where("content_full is not null").select("uri", truncate_words(F.col("content_full"), 80).alias("short_text"))


@query(f"""with {ARTICLES}, w as (select uri, content_full as t from a where content_full is not null)
select uri, regexp_matches(t, '(?i)(muss|müssen|verpflichtet|pflicht|doit|obligation|must|shall|required)') as obligation, regexp_matches(t, '(?i)(darf|dürfen|kann|können|peut|peuvent|may|can|allowed)') as permission,
  regexp_matches(t, '(?i)(frist|tage|monat|jahr|délai|jours|mois|days|months|years)') as timeline from w""")
def rule_intents(s, d):
    """Obligation, permission and timeline wording of articles; patterns search, across lines."""
    t = F.col("content_full")
    return articles(s, d).where("content_full is not null").select(
        "uri", t.rlike("(?iu)(muss|müssen|verpflichtet|pflicht|doit|obligation|must|shall|required)").alias("obligation"),
        t.rlike("(?iu)(darf|dürfen|kann|können|peut|peuvent|may|can|allowed)").alias("permission"), t.rlike("(?iu)(frist|tage|monat|jahr|délai|jours|mois|days|months|years)").alias("timeline"),
    )


@query(f"""with {ARTICLES} select uri from a where content_full is not null and
  (case when lower(content_full) like '%frist%' then 1 else 0 end) + (case when lower(content_full) like '%verband%' then 1 else 0 end) + (case when lower(content_full) like '%amt%' then 1 else 0 end) >= 0.3 * 3""")
def word_match_articles(s, d):
    """Articles with at least 30 % of the words of a question."""
    low = F.lower("content_full")
    hits = F.size(F.filter(F.array(F.lit("frist"), F.lit("verband"), F.lit("amt")), lambda w: F.contains(low, w)))
    return articles(s, d).where(F.col("content_full").isNotNull() & (hits >= 0.3 * 3)).select("uri")


@query(f"""with {LAWS} select law_uri, concat_ws('; ', case when sr_number is null then 'sr_number missing' end, case when {_sql_title('title_de')} is null and {_sql_title('title_fr')} is null and {_sql_title('title_it')} is null and {_sql_title('title_en')} is null then 'title missing' end,
  case when in_force is null then 'in_force missing' end) as warnings from l""")
def schema_warnings(s, d):
    titles = F.coalesce(*[_real_title(c) for c in ("title_de", "title_fr", "title_it", "title_en")])
    return laws(s, d).select("law_uri", F.concat_ws("; ", F.when(F.col("sr_number").isNull(), "sr_number missing"), F.when(titles.isNull(), "title missing"), F.when(F.col("in_force").isNull(), "in_force missing")).alias("warnings"))


@query(f"""with {LEVELS} select uri, coalesce(title_de, title_fr, title_it) as name, coalesce(upper(left(level_type, 1)) || lower(substr(level_type, 2)), 'Section') as label, parent_uri from t""")
def taxonomy_flat(s, d):
    label = F.concat(F.upper(F.substring("level_type", 1, 1)), F.lower(F.substring("level_type", 2, 100)))
    return levels(s, d).select("uri", F.coalesce("title_de", "title_fr", "title_it").alias("name"), F.coalesce(label, F.lit("Section")).alias("label"), "parent_uri")


# ---- joins and graph ----

@query(f"with {VERSIONS}, {LAWS} select v.law_uri as src, v.uri as dst, 'HAS_VERSION' as type from v join l using (law_uri)")
def law_version_edges(s, d):
    return G.edges_by_key(laws(s, d), "law_uri", versions(s, d), "law_uri", "uri", "HAS_VERSION")


@query(f"with {LEVELS} select p.uri as src, c.uri as dst, 'CONTAINS' as type from t c join t p on c.parent_uri = p.uri")
def containment_edges(s, d):
    t = levels(s, d)
    return G.edges_by_key(t, "uri", t, "parent_uri", "uri", "CONTAINS")


@query(f"with {ARTICLES}, {LAWS} select a.law_uri as src, a.uri as dst, 'HAS_ARTICLE' as type from a join l using (law_uri)")
def article_edges(s, d):
    return G.edges_by_key(laws(s, d), "law_uri", articles(s, d), "law_uri", "uri", "HAS_ARTICLE")


@query(f"""with {ARTICLES}, n as (select distinct variant, number_normalized as n, uri from a where variant is not null and number_normalized is not null)
select x.uri as src, y.uri as dst, 'NEXT' as type from n x join n y on x.variant = y.variant and y.n = x.n + 1""")
def article_next(s, d):
    n = articles(s, d).where("variant is not null and number_normalized is not null").select("variant", F.col("number_normalized").alias("n"), "uri")
    nxt = n.select("variant", (F.col("n") - 1).alias("n"), F.col("uri").alias("dst"))
    return n.join(nxt, ["variant", "n"]).select(F.col("uri").alias("src"), "dst", F.lit("NEXT").alias("type"))


@query(f"""with {ARTICLES}, q as (select uri as src, lead(uri) over (partition by variant order by number_normalized nulls first, number nulls first, uri) as dst from a where variant is not null) select src, dst, 'FOLLOWS' as type from q where dst is not null""")
def article_follows(s, d):
    return G.sequence_edges(articles(s, d).where("variant is not null"), "variant", ["number_normalized", "number", "uri"], "uri", "FOLLOWS")


@query(f"""with {ARTICLES}, {VARIANTS}, e as (select distinct variant as src, a.uri as dst, 'HAS_ARTICLE' as type from a where variant is not null), n as (select uri from g union select uri from a)
select src, dst, type, concat_ws('; ', case when s.uri is null then 'source missing' end, case when t.uri is null then 'target missing' end) as reason
from e left join n s on e.src = s.uri left join n t on e.dst = t.uri where s.uri is null or t.uri is null""")
def failed_edges(s, d):
    a, g = articles(s, d), variants(s, d)
    e = a.where("variant is not null").select(F.col("variant").alias("src"), F.col("uri").alias("dst"), F.lit("HAS_ARTICLE").alias("type"))
    return G.failed_edges(e, g.select("uri").union(a.select("uri")), "uri")


@query(f"""with {ARTICLES}, {VARIANTS}, n as (select uri from g union select uri from a) select distinct variant as src, a.uri as dst, 'HAS_ARTICLE' as type from a where variant in (select uri from n)""")
def valid_edges(s, d):
    a, g = articles(s, d), variants(s, d)
    e = a.where("variant is not null").select(F.col("variant").alias("src"), F.col("uri").alias("dst"), F.lit("HAS_ARTICLE").alias("type"))
    return G.valid_edges(e, g.select("uri").union(a.select("uri")), "uri")


@query(f"""with {LAWS}, {REFS}, names as (select law_uri, {_designation('sr_number')} as name from l where sr_number is not null union select law_uri, law_uri from l)
select r.ref_id, n.law_uri as target_uri from (select ref_id, {_designation('target_law')} as name from r) r join (select name, min(law_uri) as law_uri from names group by 1) n using (name)""")
def resolved_references(s, d):
    """References by number or URI to the law they name."""
    l = laws(s, d)
    names = l.select("law_uri", law_designation(F.col("sr_number")).alias("name")).where("name is not null").union(l.select("law_uri", "law_uri")).groupBy("name").agg(F.min("law_uri").alias("target_uri"))
    r = references(s, d).select("ref_id", law_designation(F.col("target_law")).alias("name"))
    return r.join(names, "name").select("ref_id", "target_uri")


@query(f"""with {REFS}, c as (select distinct law_uri, sr_number, abbreviation, {_number('number')} as number from code_articles), n as (select law_uri, {_designation('sr_number')} as name, number from c union select law_uri, {_designation('abbreviation')}, number from c union select law_uri, {_law('law_uri')}, number from c)
select distinct ref_id, law_uri, number from (select ref_id, {_designation('target_law')} as name, {_number('target_article')} as number from r) join n using (name, number)""")
def code_citations(s, d):
    """CITES edges: references to articles of the codes, by (number or abbreviation or URI, article)."""
    c = table(s, d, "code_articles").select("law_uri", F.explode(F.array(law_designation(F.col("sr_number")), law_designation(F.col("abbreviation")), law_of_uri(canonical_uri(F.col("law_uri"))))).alias("name"), article_number(F.col("number")).alias("number")).distinct()
    r = references(s, d).select("ref_id", law_designation(F.col("target_law")).alias("name"), article_number(F.col("target_article")).alias("number"))
    return r.join(c, ["name", "number"]).select("ref_id", "law_uri", "number").distinct()


@query(f"""with {LEVELS} select p.uri, p.parent_uri, count(distinct c.uri) as n_children, min(c.uri) as first_child from t p left join t c on c.parent_uri = p.uri group by 1, 2""")
def node_context(s, d):
    t = levels(s, d)
    kids = t.where("parent_uri is not null").groupBy(F.col("parent_uri").alias("uri")).agg(F.countDistinct("uri").alias("n"), F.min("uri").alias("first_child"))
    return t.select("uri", "parent_uri").join(kids, "uri", "left").select("uri", "parent_uri", F.coalesce("n", F.lit(0)).cast("long").alias("n_children"), "first_child")


def _seeds(refs: DataFrame) -> DataFrame:
    return refs.groupBy(F.col("src").alias("seed")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "seed").limit(5).select("seed")


_SEEDS = f"seeds as (select src as seed from lr group by 1 order by count(*) desc, 1 limit 5)"


@query(f"""with recursive {EDGES}, {_SEEDS}, w as (select distinct src as a, dst as b from e where src is not null and dst is not null union select dst, src from e where src is not null and dst is not null),
  b as (select seed, seed as node, 0 as length from seeds union select b.seed, w.b, b.length + 1 from b join w on b.node = w.a where b.length < 2)
select seed, node, min(length) as length from b group by 1, 2 having min(length) > 0""")
def traverse_laws(s, d):
    """Undirected traversal of two steps from the five laws with most references to others."""
    refs = materialize(law_references(s, d))  # for the seeds and for each step
    return G.traverse(_seeds(refs), law_edges(s, d, refs), 2)


@query(f"""with recursive {LAWREFS}, {_SEEDS}, w as (select src as a, dst as b from lr union select dst, src from lr), b as (select seed, seed as node, 0 as length from seeds union select b.seed, w.b, b.length + 1 from b join w on b.node = w.a where b.length < 2)
select seed, node, round(1.0 / (1 + min(length)), 6)::double as score from b group by 1, 2 having min(length) > 0""")
def reference_neighbourhood(s, d):
    refs = materialize(law_references(s, d))
    return G.traverse(_seeds(refs), refs, 2, ["REFERENCES"]).select("seed", "node", F.round(1 / (1 + F.col("length")), 6).alias("score"))


@query(f"""with {LAWREFS} select law, sum(o)::bigint as n_out, sum(i)::bigint as n_in from (select src as law, 1 as o, 0 as i from lr union all select dst, 0, 1 from lr) group by 1""")
def law_neighbours(s, d):
    e = law_references(s, d)
    both = e.select(F.col("src").alias("law"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("law").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


_PATHS = f"""{LAWS}, {VARIANTS}, {ARTICLES}, pn as (select law_uri as uri, ast_path as path from l where ast_path is not null union all select uri, ast_path from g where ast_path is not null union all select uri, ast_path from a where ast_path is not null)"""


def path_nodes(s, d):
    take = lambda df, uri: df.where("ast_path is not null").select(F.col(uri).alias("uri"), F.col("ast_path").alias("path"))
    return take(laws(s, d), "law_uri").unionByName(take(variants(s, d), "uri")).unionByName(take(articles(s, d), "uri"))


@query(f"""with {_PATHS}, k0 as (select uri, path, unnest(range(2, len(string_split(path, '/')))) as i from pn), k as (select uri, array_to_string(string_split(path, '/')[:i], '/') as p from k0)
select pn.uri as ancestor, k.uri as descendant from k join pn on k.p = pn.path""")
def path_ancestors(s, d):
    return G.path_pairs(path_nodes(s, d), "uri", "path")


@query(f"""with {_PATHS} select len(string_split(path, '/')) - 1 as path_level, count(*) as n from pn group by 1""")
def path_level_counts(s, d):
    return path_nodes(s, d).groupBy((F.size(F.split("path", "/")) - 1).cast("long").alias("path_level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_PATHS} select uri, path from pn where starts_with(path, '/sr_1') and contains(path, '/de') and contains(path, 'art_1')""")
def path_pattern(s, d):
    return path_nodes(s, d).where(G.matches_pattern(F.col("path"), "/sr_1*/de*art_1"))


@query(f"""with {_PATHS}, f as (select uri, path, len(string_split(path, '/')) - 1 as lv, regexp_replace(path, '/[^/]*$', '') as up from pn)
select x.uri, count(*) - 1 as n_siblings from f x join f y on x.up = y.up and x.lv = y.lv group by 1""")
def path_siblings(s, d):
    p = path_nodes(s, d).withColumn("up", F.regexp_replace("path", "/[^/]*$", ""))
    n = p.groupBy("up").agg((F.count(F.lit(1)) - 1).alias("n_siblings"))
    return p.join(n, "up").select("uri", "n_siblings")


@query(f"""with {_PATHS}, f as (select uri, path, len(string_split(path, '/')) - 1 as lv from pn)
select uri, round(least(1.0, 0.5 + case when lv = 3 then 0.3 when abs(lv - 3) = 1 then 0.1 else 0 end + case when contains(path, 'art_1') then 0.1 else 0 end + (8 - lv) * 0.02), 6)::double as score from f""")
def path_scores(s, d):
    lv = F.size(F.split("path", "/")) - 1
    score = 0.5 + F.when(lv == 3, 0.3).when(F.abs(lv - 3) == 1, 0.1).otherwise(0.0) + F.when(F.col("path").contains("art_1"), 0.1).otherwise(0.0) + (8 - lv) * 0.02
    return path_nodes(s, d).select("uri", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


@query(f"with {LAWS}, {ARTICLES} select law_uri from l where law_uri not in (select law_uri from a where law_uri is not null)")
def laws_without_articles(s, d):
    return laws(s, d).select("law_uri").join(articles(s, d).select("law_uri"), "law_uri", "left_anti")


@query(f"with {VERSIONS} select uri, law_uri from v where uri not in (select {_uri('version_uri')} from law_language_variants where version_uri is not null)")
def isolated_versions(s, d):
    """Versions that no language variant is of."""
    known = table(s, d, "law_language_variants").select(canonical_uri(F.col("version_uri")).alias("uri")).where("uri is not null").distinct()
    return versions(s, d).join(known, "uri", "left_anti").select("uri", "law_uri")


# ---- ingest ----

_OLD, _NEW = "loaded_at < timestamp '2024-01-01'", "loaded_at >= timestamp '2024-01-01'"


@query(f"""with raw as (select {_uri('uri')} as uri, sr_number, title_de, title_fr, in_force, loaded_at from law_nodes),
  o as (select * from (select *, row_number() over (partition by uri order by loaded_at desc, sr_number desc nulls last, title_de desc nulls last, title_fr desc nulls last, in_force desc nulls last) rn from raw where {_OLD}) where rn = 1),
  n as (select * from (select *, row_number() over (partition by uri order by loaded_at desc, sr_number desc nulls last, title_de desc nulls last, title_fr desc nulls last, in_force desc nulls last) rn from raw where {_NEW}) where rn = 1)
select coalesce(n.uri, o.uri) as uri, coalesce(n.sr_number, o.sr_number) as sr_number, coalesce(n.title_de, o.title_de) as title_de, coalesce(n.title_fr, o.title_fr) as title_fr, coalesce(n.in_force, o.in_force) as in_force,
  case when o.uri is null then 'created' when n.uri is null then 'kept' else 'merged' end as upsert_state from n full join o on n.uri = o.uri""")
def upsert_laws(s, d):
    raw = table(s, d, "law_nodes").withColumn("uri", canonical_uri(F.col("uri")))
    cols = ["sr_number", "title_de", "title_fr", "in_force"]
    half = lambda cond: latest_delivery(raw.where(cond), ["uri"], "loaded_at", cols).drop("loaded_at")
    return G.upsert(half("loaded_at < timestamp_ntz'2024-01-01 00:00:00'"), half("loaded_at >= timestamp_ntz'2024-01-01 00:00:00'"), "uri")


@query("""with x as (select distinct file_path, sha256(payload) as h, loaded_at < timestamp '2024-07-01' as done from fedlex_json)
select file_path, h as content_hash from x where not done and not exists (select 1 from x y where y.done and y.file_path = x.file_path and y.h = x.h)""")
def incremental_files(s, d):
    """Files that are new or changed since the last run, by path and content hash."""
    x = table(s, d, "fedlex_json").select("file_path", F.sha2("payload", 256).alias("content_hash"), (F.col("loaded_at") < F.expr("timestamp_ntz'2024-07-01 00:00:00'")).alias("done")).distinct()
    return x.where("not done").join(x.where("done"), ["file_path", "content_hash"], "left_anti").select("file_path", "content_hash")


@query("""with x as (select distinct record_id, payload::json as v from fedlex_json where json_valid(payload)), y as (select record_id, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') else [v] end) as e from x),
  z as (select record_id, case when json_type(e->'data') = 'OBJECT' then e->'data' else e end as o from y), t as (select record_id, coalesce((o->'type')::varchar, '') as t, coalesce(case when json_type(o->'uri') = 'VARCHAR' then o->>'uri' end, '') as u from z where json_type(o) = 'OBJECT')
select record_id, u as uri, contains(t, '"ConsolidationAbstract"') as is_law, contains(t, '"Consolidation"') or contains(t, '"Expression"') or regexp_matches(u, '/\\d{8}(/|$)') as is_version, contains(t, '"Act"') or contains(u, '/oc/') or contains(u, '/fga/') as is_act from t""")
def entity_dispatch(s, d):
    """Which extractors each document of a record goes to, by the types and URI of its data, or of the object itself where there is no data; a payload may be a list."""
    v = F.try_parse_json("payload")
    rows = table(s, d, "fedlex_json").select("record_id", "payload").distinct().select("record_id", v.alias("v")).where("v is not null")
    rows = rows.select("record_id", F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("e"))
    is_object = lambda c: F.schema_of_variant(c).startswith("OBJECT")
    data = F.try_variant_get("e", "$.data", "variant")
    rows = rows.select("record_id", F.when(F.coalesce(is_object(data), F.lit(False)), data).otherwise(F.col("e")).alias("o")).where(is_object(F.col("o")))
    t, u = F.coalesce(F.to_json(F.try_variant_get("o", "$.type", "variant")), F.lit("")), F.coalesce(F.try_variant_get("o", "$.uri", "string"), F.lit(""))
    has = lambda name: F.col("t").contains(f'"{name}"')
    return rows.select("record_id", u.alias("uri"), t.alias("t")).select(
        "record_id", "uri", has("ConsolidationAbstract").alias("is_law"), (has("Consolidation") | has("Expression") | F.col("uri").rlike(r"/\d{8}(/|$)")).alias("is_version"),
        (has("Act") | F.col("uri").contains("/oc/") | F.col("uri").contains("/fga/")).alias("is_act"),
    )


@query("""with f as (select distinct source_file from html_references where source_file is not null), p as (select regexp_replace(source_file, '-\\d+\\.html$', '.html') as base_file, coalesce(try_cast(nullif(regexp_extract(source_file, '-(\\d+)\\.html$', 1), '') as int), 0) as page from f)
select base_file, count(*) as n_pages, max(page) as last_page from p group by 1""")
def paginated_files(s, d):
    f = table(s, d, "html_references").select("source_file").where("source_file is not null").distinct()
    page = F.coalesce(F.nullif(F.regexp_extract("source_file", r"-(\d+)\.html$", 1), F.lit("")).cast("int"), F.lit(0))
    return f.select(F.regexp_replace("source_file", r"-\d+\.html$", ".html").alias("base_file"), page.alias("page")).groupBy("base_file").agg(F.count(F.lit(1)).alias("n_pages"), F.max("page").alias("last_page"))


@query("""with j as (select distinct regexp_extract(file_path, '^(/eli/[^/]+/[^/]+/[^/.]+)', 1) as k from fedlex_json), h as (select distinct regexp_extract(source_file, '^(/eli/[^/]+/[^/]+/[^/.]+)', 1) as k from html_references)
select k as law_key from j where k <> '' and k in (select k from h)""")
def json_html_laws(s, d):
    """Laws that have both a JSON and an HTML file."""
    key = lambda c: F.regexp_extract(c, r"^(/eli/[^/]+/[^/]+/[^/.]+)", 1).alias("law_key")
    j, h = table(s, d, "fedlex_json").select(key("file_path")).distinct(), table(s, d, "html_references").select(key("source_file")).distinct()
    return j.where("law_key <> ''").join(h, "law_key", "left_semi")


@query(f"select {_uri('uri')} as uri, count(*) as n_rows from law_nodes where uri is not null group by 1 having count(*) > 1")
def uniqueness_violations(s, d):
    return G.count_by(table(s, d, "law_nodes").select(canonical_uri(F.col("uri")).alias("uri")).where("uri is not null"), "uri").withColumnRenamed("n", "n_rows").where("n_rows > 1")


# ---- aggregates ----

@query(f"""with {EDGES}, {ARTICLES}, {LEVELS} select 'Law' as label, count(*) as n from l union all select 'Version', count(*) from v union all select 'LawLanguageVariant', count(*) from g union all select 'Article', count(*) from a union all select 'TaxonomyLevel', count(*) from t
union all select type, count(*) from e group by type""")
def label_counts(s, d):
    one = lambda df, label: df.agg(F.lit(label).alias("label"), F.count(F.lit(1)).alias("n"))
    nodes = one(laws(s, d), "Law").unionByName(one(versions(s, d), "Version")).unionByName(one(variants(s, d), "LawLanguageVariant")).unionByName(one(articles(s, d), "Article")).unionByName(one(levels(s, d), "TaxonomyLevel"))
    return nodes.unionByName(G.count_by(law_edges(s, d).withColumnRenamed("type", "label"), "label"))


@query(f"with {VERSIONS} select law_uri, count(*) as n_versions from v group by 1 having count(*) > 4")
def laws_with_many_versions(s, d):
    return G.count_by(versions(s, d), "law_uri").withColumnRenamed("n", "n_versions").where("n_versions > 4")


@query(f"with {ARTICLES}, c as (select law_uri, count(*) as n from a where law_uri is not null group by 1) select round(avg(n), 6) as avg_articles, min(n) as min_articles, max(n) as max_articles, count(*) as n_laws from c")
def articles_per_law(s, d):
    n = G.count_by(articles(s, d).where("law_uri is not null"), "law_uri")
    return n.agg(F.round(F.avg("n"), 6).alias("avg_articles"), F.min("n").alias("min_articles"), F.max("n").alias("max_articles"), F.count(F.lit(1)).alias("n_laws"))


@query(f"""with {LAWS}, {ARTICLES}, {VERSIONS}, h as (select law_uri, {_sql_title('title_de')} is not null as de, {_sql_title('title_fr')} is not null as fr, {_sql_title('title_it')} is not null as it, law_uri in (select law_uri from a where law_uri is not null) as art, law_uri in (select law_uri from v) as ver from l)
select count(*) as n_laws, round(100.0 * avg(art::int), 6)::double as content_coverage, round((sum(de::int) + sum(fr::int) + sum(it::int)) * 100.0 / (3 * count(*)), 6)::double as language_coverage, round((sum(art::int) + sum(ver::int)) * 100.0 / (2 * count(*)), 6)::double as structural_coverage from h""")
def coverage(s, d):
    l = laws(s, d)
    a = articles(s, d).select("law_uri").where("law_uri is not null").distinct().withColumn("art", F.lit(1))
    v = versions(s, d).select("law_uri").distinct().withColumn("ver", F.lit(1))
    j = l.join(a, "law_uri", "left").join(v, "law_uri", "left")
    n = F.count(F.lit(1))
    titles = sum((F.count(_real_title(c)) for c in ("title_de", "title_fr", "title_it")), F.lit(0))
    return j.agg(n.alias("n_laws"), F.round(100.0 * F.count("art") / n, 6).alias("content_coverage"), F.round(titles * 100.0 / (3 * n), 6).alias("language_coverage"), F.round((F.count("art") + F.count("ver")) * 100.0 / (2 * n), 6).alias("structural_coverage"))


@query(f"""with {ARTICLES} select lang, count(*) as n_articles, count(content_full) as with_content, count(title) as with_title, count(distinct law_uri) as n_laws from a group by rollup (lang)""")
def articles_by_language(s, d):
    return articles(s, d).rollup("lang").agg(F.count(F.lit(1)).alias("n_articles"), F.count("content_full").alias("with_content"), F.count("title").alias("with_title"), F.countDistinct("law_uri").alias("n_laws"))


@query(f"""with {ARTICLES} select law_uri, number, count(distinct lang) as n_languages, min(title) filter (lang = 'de') as title_de, min(title) filter (lang = 'fr') as title_fr, min(title) filter (lang = 'it') as title_it from a where law_uri is not null group by 1, 2""")
def article_titles_merged(s, d):
    of = lambda lang: F.min(F.when(F.col("lang") == lang, F.col("title"))).alias(f"title_{lang}")
    return articles(s, d).where("law_uri is not null").groupBy("law_uri", "number").agg(F.countDistinct("lang").alias("n_languages"), of("de"), of("fr"), of("it"))


@query(f"""with {ARTICLES} select variant, count(*) filter (number is null) as without_number, count(*) - count(distinct number) - count(*) filter (number is null) as repeated_numbers, count(*) filter (coalesce(trim(content_full), '') = '') as without_content from a where variant is not null group by 1 having without_number > 0 or repeated_numbers > 0 or without_content > 0""")
def content_validation(s, d):
    bad = articles(s, d).where("variant is not null").groupBy("variant").agg(F.count_if(F.col("number").isNull()).alias("without_number"), (F.count("number") - F.countDistinct("number")).alias("repeated_numbers"), F.count_if(F.coalesce(F.trim("content_full"), F.lit("")) == "").alias("without_content"))
    return bad.where("without_number > 0 or repeated_numbers > 0 or without_content > 0")


@query("""with x as (select event_type as stage, value, row_number() over (partition by event_type order by value, event_id) as r, count(*) over (partition by event_type) as n from events where value is not null)
select stage, count(*) as total, round(avg(value), 4) as avg_value, min(value) as min_value, max(value) as max_value, round(median(value), 4) as p50, max(value) filter (r = least(floor(n * 0.95), n - 1) + 1) as p95, max(value) filter (r = least(floor(n * 0.99), n - 1) + 1) as p99 from x group by 1""")
def latency_percentiles(s, d):
    """Metrics of stages; p95 and p99 take the value at index floor(n·q)."""
    w = Window.partitionBy("stage")
    # counts per value keep the window small: ranks run over distinct values, not over events
    v = table(s, d, "events").where("value is not null").groupBy(F.col("event_type").alias("stage"), "value").agg(F.count(F.lit(1)).alias("c"))
    v = v.withColumns({"upto": F.sum("c").over(w.orderBy("value")), "n": F.sum("c").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1, F.col("value")))
    lo = F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("value")))
    hi = F.min(F.when(F.col("upto") * 2 > F.col("n"), F.col("value")))
    return v.groupBy("stage").agg(F.sum("c").alias("total"), F.round(F.sum(F.col("value") * F.col("c")) / F.sum("c"), 4).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.round((lo + hi) / 2, 4).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("""with e as (select user_id, ts, event_id, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
  g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from e) select user_id, min(ts) as session_start, count(*) as n_turns from g group by user_id, sid""")
def sessions(s, d):
    """Dialogue sessions by 30 minutes of inactivity."""
    e = table(s, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n_turns"))
    return e.select("user_id", F.col("session_window.start").alias("session_start"), "n_turns")


@query("""select event_type, date_trunc('hour', ts) as hour, count(*) as n_errors, round(sum(value), 4) as total from events where event_type = 'error' group by 1, 2""")
def error_statistics(s, d):
    return table(s, d, "events").where("event_type = 'error'").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n_errors"), F.round(F.sum("value"), 4).alias("total"))


# ---- retrieval ----

_TF = [f"((length(t) - length(replace(t, '{w}', ''))) // length('{w}'))" for w in WORDS]
_BM25 = f"""x as (select doc_id, length(lower(text)) as len, {', '.join(f'{e} as tf{i}' for i, e in enumerate(_TF))} from (select doc_id, text, lower(text) as t from documents where text is not null)),
  st as (select count(*) as n, avg(len) as av, {', '.join(f'count(*) filter (tf{i} > 0) as df{i}' for i in range(len(WORDS)))} from x),
  b as (select doc_id, {' + '.join(f'ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * len / av))' for i in range(len(WORDS)))} as bm25 from x, st where {' or '.join(f'tf{i} > 0' for i in range(len(WORDS)))})"""


@query(f"with {_BM25} select doc_id, round(bm25, 6) as bm25, round(bm25 / max(bm25) over (), 6) as bm25_norm from b order by bm25 desc, doc_id limit 20")
def bm25_topk(s, d):
    scored = R.bm25(dealt(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", WORDS)
    top = scored.orderBy(F.desc("bm25"), "doc_id").limit(20)
    return top.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round(F.col("bm25") / F.max("bm25").over(Window.partitionBy(F.lit(1))), 6).alias("bm25_norm"))


_COS = "q as (select embedding::double[] as qv from embeddings where vec_id = 0), c as (select vec_id, label, list_cosine_similarity(embedding::double[], qv) as cos from embeddings, q)"


def _cosines(s, d):
    """Cosine of every vector with the one query vector, by products of blocks."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return R.block_cosines(e, e.where("id = 0").limit(1)).select(F.col("id").alias("vec_id"), "label", "cos")


@query(f"with {_COS} select vec_id, round(cos, 6) as cos from c order by cos desc, vec_id limit 20")
def cosine_topk(s, d):
    return _cosines(s, d).orderBy(F.desc("cos"), "vec_id").limit(20).select("vec_id", F.round("cos", 6).alias("cos"))


@query(f"with {_COS} select label, vec_id, round(cos, 6) as cos from c qualify row_number() over (partition by label order by cos desc, vec_id) <= 3")
def cosine_topk_per_label(s, d):
    return R.top_per_group(_cosines(s, d), ["label"], [F.desc("cos"), F.asc("vec_id")], 3).select("label", "vec_id", F.round("cos", 6).alias("cos"))


@query(f"""with {_COS}, {_BM25}, h as (select coalesce(c.vec_id, b.doc_id) as id, coalesce((1 + cos) / 2, 0) as v, coalesce(bm25 / (select max(bm25) from b), 0) as k from c full join b on c.vec_id = b.doc_id)
select id, round(0.6 * v + 0.4 * k, 6) as hybrid from h where 0.6 * v + 0.4 * k >= 0.3 order by 0.6 * v + 0.4 * k desc, id limit 50""")
def hybrid_search(s, d):
    """Flagship: keyword scores normalized by their maximum and rescaled cosine, outer-joined and weighted."""
    b = R.bm25(dealt(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", WORDS)
    top = b.agg(F.max("bm25").alias("m"))
    k = b.join(F.broadcast(top)).select(F.col("doc_id").alias("id"), (F.col("bm25") / F.col("m")).alias("k"))
    v = _cosines(s, d).select(F.col("vec_id").alias("id"), ((1 + F.col("cos")) / 2).alias("v"))
    h = v.join(k, "id", "full_outer").select("id", (0.6 * F.coalesce("v", F.lit(0.0)) + 0.4 * F.coalesce("k", F.lit(0.0))).alias("h"))
    return h.where("h >= 0.3").orderBy(F.desc("h"), "id").limit(50).select("id", F.round("h", 6).alias("hybrid"))


@query(f"""with {_COS} select vec_id, round(case when max(cos) over w = min(cos) over w then 0.5 else (cos - min(cos) over w) / (max(cos) over w - min(cos) over w) end, 6) as minmax,
  round(case when stddev_pop(cos) over w = 0 then 0.5 else 1 / (1 + exp(-(cos - avg(cos) over w) / stddev_pop(cos) over w)) end, 5) as zscore, round(1 - (row_number() over (partition by label order by cos desc, vec_id desc) - 1) / count(*) over w, 6) as rank_score from c window w as (partition by label)""")
def normalized_scores(s, d):
    return _rounded(R.normalized(_cosines(s, d), ["label"], "cos", [F.desc("cos"), F.desc("vec_id")]), "vec_id")


def _rounded(scores, *keys):
    return scores.select(*keys, F.round("minmax", 6).alias("minmax"), F.round("zscore", 5).alias("zscore"), F.round("rank_score", 6).alias("rank_score"))


_METHODS = f"""{_COS}, {_BM25}, m as (select vec_id::varchar as uri, 'vector' as method, greatest(cos, 0) as score from c union all select doc_id::varchar, 'hybrid', bm25 / (select max(bm25) from b) from b),
  f as (select uri, sum(case method when 'vector' then 0.3 else 0.3 end * score) as sc, count(*) as n_methods, string_agg(method, ',' order by method) as methods from m group by 1)"""


def _method_results(s, d):
    b = R.bm25(dealt(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", WORDS)
    m = b.agg(F.max("bm25").alias("m"))
    k = b.join(F.broadcast(m)).select(F.col("doc_id").cast("string").alias("uri"), F.lit("hybrid").alias("method"), (F.col("bm25") / F.col("m")).alias("score"))
    v = _cosines(s, d).select(F.col("vec_id").cast("string").alias("uri"), F.lit("vector").alias("method"), F.greatest(F.col("cos"), F.lit(0.0)).alias("score"))
    return v.unionByName(k)


@query(f"with {_METHODS} select uri, round(case when n_methods > 1 then least(1.0, sc + 0.1 * (n_methods - 1)) else sc end, 5) as combined_score, n_methods, methods from f")
def fused_results(s, d):
    return R.merge_methods(_method_results(s, d), {"vector": 0.3, "graph": 0.2, "ast": 0.2, "hybrid": 0.3}).withColumn("combined_score", F.round("combined_score", 5))


@query(f"with {_METHODS} select methods, count(*) as n_results from f group by 1")
def merge_statistics(s, d):
    return R.merge_methods(_method_results(s, d), {"vector": 0.3, "hybrid": 0.3}).groupBy("methods").agg(F.count(F.lit(1)).alias("n_results"))


# the same for every stated query: all vectors whose id is divisible by 100, each against all

_COS_ALL = "c as (select q.vec_id as query_id, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 12) as cos from embeddings e, embeddings q where q.vec_id % 100 = 0)"


def _all_cosines(s, d, k=None, per_label=False):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return R.block_cosines(e, e.where("id % 100 = 0"), k, per_label).withColumnRenamed("id", "vec_id")


def _keyword(s, d):
    b = R.bm25(dealt(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", WORDS)
    return b.join(F.broadcast(b.agg(F.max("bm25").alias("m")))).select(F.col("doc_id").alias("id"), (F.col("bm25") / F.col("m")).alias("k"))


def _query_ids(s, d):
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))


@query(f"with {_COS_ALL} select query_id, vec_id, round(cos, 6) as cos from c qualify row_number() over (partition by query_id order by c.cos desc, vec_id) <= 20")
def cosine_topk_all(s, d):
    return R.top_per_group(_all_cosines(s, d, 20), ["query_id"], [F.desc("cos"), F.asc("vec_id")], 20).select("query_id", "vec_id", F.round("cos", 6).alias("cos"))


@query(f"with {_COS_ALL} select query_id, label, vec_id, round(cos, 6) as cos from c qualify row_number() over (partition by query_id, label order by c.cos desc, vec_id) <= 3")
def cosine_topk_per_label_all(s, d):
    return R.top_per_group(_all_cosines(s, d, 3, True), ["query_id", "label"], [F.desc("cos"), F.asc("vec_id")], 3).select("query_id", "label", "vec_id", F.round("cos", 6).alias("cos"))


@query(f"""with {_COS_ALL}, {_BM25}, kw as (select q.vec_id as query_id, doc_id, bm25 / (select max(bm25) from b) as k from b, embeddings q where q.vec_id % 100 = 0),
  h as (select coalesce(c.query_id, kw.query_id) as query_id, coalesce(c.vec_id, kw.doc_id) as id, 0.6 * coalesce((1 + cos) / 2, 0) + 0.4 * coalesce(k, 0) as h from c full join kw on c.vec_id = kw.doc_id and c.query_id = kw.query_id)
select query_id, id, round(h, 6) as hybrid from h where h >= 0.3 qualify row_number() over (partition by query_id order by h desc, id) <= 50""")
def hybrid_search_all(s, d):
    k = materialize(_keyword(s, d))
    v = _all_cosines(s, d).select("query_id", F.col("vec_id").alias("id"), ((1 + F.col("cos")) / 2).alias("v"))
    both = v.join(k, "id", "left").select("query_id", "id", (0.6 * F.col("v") + 0.4 * F.coalesce("k", F.lit(0.0))).alias("h"))
    rest = k.join(table(s, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti").select("id", (0.4 * F.col("k") + 0.0).alias("h")).where("h >= 0.3")
    # without a vector a document scores alike for every query: its best 50 are the same
    rest = rest.orderBy(F.desc("h"), "id").limit(50).crossJoin(_query_ids(s, d)).select("query_id", "id", "h")
    return R.top_per_group(both.unionByName(rest).where("h >= 0.3"), ["query_id"], [F.desc("h"), F.asc("id")], 50).select("query_id", "id", F.round("h", 6).alias("hybrid"))


@query(f"""with {_COS_ALL} select query_id, vec_id, round(case when max(cos) over w = min(cos) over w then 0.5 else (cos - min(cos) over w) / (max(cos) over w - min(cos) over w) end, 6) as minmax,
  round(case when stddev_pop(cos) over w = 0 then 0.5 else 1 / (1 + exp(-(cos - avg(cos) over w) / stddev_pop(cos) over w)) end, 5) as zscore, round(1 - (row_number() over (partition by query_id, label order by cos desc, vec_id desc) - 1) / count(*) over w, 6) as rank_score from c window w as (partition by query_id, label)""")
def normalized_scores_all(s, d):
    return _rounded(R.normalized(_all_cosines(s, d), ["query_id", "label"], "cos", [F.desc("cos"), F.desc("vec_id")]), "query_id", "vec_id")


_METHODS_ALL = f"""{_COS_ALL}, {_BM25}, m as (select query_id, vec_id as uri, 'vector' as method, greatest(cos, 0) as score from c union all select q.vec_id, doc_id, 'hybrid', bm25 / (select max(bm25) from b) from b, embeddings q where q.vec_id % 100 = 0),
  f as (select query_id, uri, sum(0.3 * score) as sc, count(*) as n_methods, string_agg(method, ',' order by method) as methods from m group by 1, 2)"""


def _all_merged(s, d):
    """Results of both methods for each query; the query goes into the key."""
    key = F.concat_ws("/", "query_id", "id").alias("uri")
    v = _all_cosines(s, d).withColumnRenamed("vec_id", "id").select(key, F.lit("vector").alias("method"), F.greatest(F.col("cos"), F.lit(0.0)).alias("score"))
    k = materialize(_keyword(s, d)).crossJoin(_query_ids(s, d)).select(key, F.lit("hybrid").alias("method"), F.col("k").alias("score"))
    at = F.split("uri", "/")
    return R.merge_methods(v.unionByName(k), {"vector": 0.3, "hybrid": 0.3}).withColumns({"query_id": at[0].cast("long"), "uri": at[1]})


@query(f"with {_METHODS_ALL} select query_id, uri::varchar as uri, round(case when n_methods > 1 then least(1.0, sc + 0.1 * (n_methods - 1)) else sc end, 5) as combined_score, n_methods, methods from f")
def fused_results_all(s, d):
    return _all_merged(s, d).select("query_id", "uri", F.round("combined_score", 5).alias("combined_score"), "n_methods", "methods")


@query(f"with {_METHODS_ALL} select query_id, methods, count(*) as n_results from f group by 1, 2")
def merge_statistics_all(s, d):
    return _all_merged(s, d).groupBy("query_id", "methods").agg(F.count(F.lit(1)).alias("n_results"))


_TOLD = ", ".join(f"len(list_filter(ws, lambda w: w in ({', '.join(repr(x) for x in words.split())}))) as {lang}" for lang, words in LANGUAGE_WORDS.items())


@query(f"""with w as (select lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as ws from documents where text is not null), n as (select lang as declared, {_TOLD} from w)
select declared as lang, case when greatest(de, fr, it, en) = 0 or de = greatest(de, fr, it, en) then 'de' when fr = greatest(de, fr, it, en) then 'fr' when it = greatest(de, fr, it, en) then 'it' else 'en' end as detected, count(*) as n_docs from n group by 1, 2""")
def document_languages(s, d):
    """Language by stop words beside the declared one."""
    docs = dealt(table(s, d, "documents").select("lang", "text")).where("text is not null")
    return docs.groupBy("lang", detect_language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n_docs"))


# ---- question analysis, on the texts around references ----

def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _told(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quoted(pattern)})::int"


def _question_sql() -> str:
    """The analysis as SQL, from the same patterns."""
    names = list(Q.INTENTS)
    hits = ", ".join(f"{' + '.join(_told('low', p) for p in ps)} as h_{n}" for n, (_, ps) in Q.INTENTS.items())
    scores = {n: f"h_{n} * {w}::double" for n, (w, _) in Q.INTENTS.items()}
    best = f"greatest({', '.join(scores.values())})"
    name = f"case {' '.join(f"when {scores[n]} = {best} then '{n}'" for n in names)} end"
    found = ", ".join(f"len(regexp_extract_all(t, {_quoted('(?i)' + p)}, 1)) as n_{n}" for n, p in Q.ENTITIES.items())
    ambiguous = " + ".join(f"{_told('t', '(?i)' + p)} * 1.5::double" for p in Q.AMBIGUITY)
    pick = lambda table: f"case intent {' '.join(f"when '{k}' then '{v}'" for k, v in table.items())} end"
    return f"""with q0 as (select doc_id, regexp_replace(regexp_replace(regexp_replace(translate(text, '{Q.MARKED}', '{Q.BARE}'), '[\u0300-\u036f]', '', 'g'), '[^ -~§]', ' ', 'g'), ' +', ' ', 'g') as t from documents where text is not null), q as (select *, lower(t) as low from q0),
  a as (select *, {hits}, {found}, len(string_split(trim(t), ' ')) as n_words, least(1.0::double, ({ambiguous} + {_told('t', '(?i)' + Q.VAGUE)} * 1.0::double + {_told('t', '(?i)' + Q.PRONOUNS)} * 0.5::double + contains(low, 'maybe')::int * 2.0::double) / {len(Q.AMBIGUITY) * 1.5 + 3.5}::double) as ambiguity from q),
  b as (select *, {' + '.join(f'(h_{n} > 0)::int' for n in names)} as kinds, {name} as best, {' + '.join(f'n_{n}' for n in Q.ENTITIES)} as n_entities from a),
  c as (select *, case when kinds = 0 then 'exploratory' else best end as intent, case best {' '.join(f"when '{n}' then h_{n}" for n in names)} end as hits from b),
  d as (select *, case when hits >= 2 then 0.8::double else 0.6::double end as c0 from c), e as (select *, case when kinds = 1 then least(1.0::double, c0 * 1.2) else c0 end as c1 from d),
  f as (select *, case when kinds = 0 then 0.5::double when best in ('comparative', 'procedural') then least(1.0::double, c1 * 1.2) else c1 end as confidence,
    case when n_words > 30 then 2 when n_words > 15 then 1 else 0 end + case when n_entities > 3 then 2 when n_entities > 1 then 1 else 0 end + (len(regexp_extract_all(t, {_quoted(Q.CONNECTIVES)})) > 2)::int + {_told('t', '(?i)' + Q.CONTRAST)} + {_told('t', '(?i)' + Q.CONDITIONAL)} as level from e),
  g as (select *, case when level >= 3 then 'complex' when level >= 2 then 'medium' else 'simple' end as complexity from f)
select doc_id, intent, round(confidence, 4) as confidence, n_entities::int as n_entities, complexity, round(ambiguity, 4) as ambiguity, array_to_string(list_filter([case when {_told('low', Q.RECENT)} = 1 and n_dates = 0 then 'time_period' end,
    case when not regexp_matches(low, 'swiss|switzerland') and regexp_matches(low, 'law|legal|statute|regulation') then 'jurisdiction' end, case when {_told('low', Q.SPECIFIC)} = 1 and not regexp_matches(low, 'naturalization|visa|income|real estate') then 'specific_type' end,
    case when {_told('low', Q.SCOPED)} = 1 and n_laws = 0 then 'specific_law_or_context' end], lambda x: x is not null), ',') as missing_context, n_articles > 0 as has_article,
  case when round(ambiguity, 4) > 0.6 or complexity = 'complex' then 'hybrid' when n_articles > 0 then 'ast' when intent in ('definitional', 'factual') then 'vector' else {pick(Q.STRATEGIES)} end as strategy, {pick(Q.FALLBACKS)} as fallback from g"""


@query(_question_sql())
def question_analysis(s, d):
    """Texts read as questions: intent, entities, complexity, ambiguity, what is missing, strategy and fallback."""
    docs = dealt(table(s, d, "documents").select("doc_id", "text")).where("text is not null").select("doc_id", Q.plain_text(F.col("text")).alias("text"))
    t = F.col("text")
    # in stages, so that what several columns read is matched once
    a = docs.select("doc_id", "text", Q.intent_scores(t).alias("scored"), Q.entities(t).alias("e")).withColumn("i", Q.intent(F.col("scored")))
    n = sum((F.size(f"e.{name}") for name in Q.ENTITIES), F.lit(0))
    a = a.withColumns({"n_entities": n, "ambiguous": Q.ambiguity(t), "missing_context": F.array_join(Q.missing_context(t, F.size("e.dates"), F.size("e.laws")), ",")})
    a = a.select("doc_id", "i.intent", F.round("i.confidence", 4).alias("confidence"), "n_entities", Q.complexity(t, F.col("n_entities")).alias("complexity"), F.round("ambiguous", 4).alias("ambiguity"), "missing_context", (F.size("e.articles") > 0).alias("has_article"))
    return a.withColumns({"strategy": Q.strategy(F.col("intent"), F.col("has_article"), F.col("ambiguity"), F.col("complexity")), "fallback": Q.fallback(F.col("intent"))})


@query(f"""with x as ({_question_sql()}), m as (select doc_id, ambiguity, unnest(string_split(missing_context, ',')) as missing from x where missing_context <> ''),
  k as (select doc_id, missing, case missing {' '.join(f"when '{k}' then {i + 1}" for i, k in enumerate(Q.CLARIFICATIONS))} end as priority, case missing {' '.join(f"when '{k}' then '{v}'" for k, v in Q.CLARIFICATIONS.items())} end as question from m)
select * from k qualify row_number() over (partition by doc_id order by priority) <= {Q.MOST_CLARIFICATIONS}""")
def clarifications(s, d):
    """Questions back to the asker for what is missing, the first by priority; a text lacks four things at most, so they are cut within its row."""
    known = list(Q.CLARIFICATIONS)
    names, asked = F.array(*map(F.lit, known)), F.array(*[F.lit(v) for v in Q.CLARIFICATIONS.values()])
    ranks = F.slice(F.array_sort(F.transform(F.split("missing_context", ","), lambda m: F.array_position(names, m).cast("int"))), 1, Q.MOST_CLARIFICATIONS)
    k = question_analysis(s, d).where("missing_context <> ''").select("doc_id", F.explode(ranks).alias("priority"))
    return k.select("doc_id", F.get(names, F.col("priority") - 1).alias("missing"), "priority", F.get(asked, F.col("priority") - 1).alias("question"))


@query(f"""with {REFS}, p as (select ref_id, raw_text, nullif(regexp_extract(raw_text, '(\\d+\\.\\d+)', 1), '') as sr, nullif(regexp_extract(raw_text, '(?i)art\\.?\\s*(\\d+[a-z]*)', 1), '') as article from r where raw_text is not null)
select ref_id, sr, article, case when article is not null then 'ARTICLE' when sr is not null then 'LAW' end as search_level from p""")
def structure_hints(s, d):
    r = references(s, d).where("raw_text is not null").select("ref_id", F.nullif(F.regexp_extract("raw_text", r"(\d+\.\d+)", 1), F.lit("")).alias("sr"), F.nullif(F.regexp_extract("raw_text", r"(?i)art\.?\s*(\d+[a-z]*)", 1), F.lit("")).alias("article"))
    return r.withColumn("search_level", F.when(F.col("article").isNotNull(), "ARTICLE").when(F.col("sr").isNotNull(), "LAW"))


# ---- citations and evidence ----

@query(f"""with {REFS}, c as (select ref_id, {_designation('target_law')} as law, {_number('target_article')} as article, (raw_text is not null)::int + (context_text is not null)::int + (target_article is not null)::int as filled from r where target_law is not null)
select law, article, arg_min(ref_id, (-filled, ref_id)) as ref_id, count(*) as n_copies from c where law is not null group by 1, 2""")
def deduplicated_citations(s, d):
    """Of the citations of one article the most complete, then the first."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("raw_text", "context_text", "target_article")), F.lit(0))
    c = references(s, d).select("ref_id", law_designation(F.col("target_law")).alias("law"), article_number(F.col("target_article")).alias("article"), filled.alias("f")).where("law is not null")
    return c.groupBy("law", "article").agg(F.min(F.struct(-F.col("f"), "ref_id"))["ref_id"].alias("ref_id"), F.count(F.lit(1)).alias("n_copies"))


@query(f"""with {REFS}, c as (select {_designation('target_law')} as law, {_number('target_article')} as article from r) select law, count(*) as n_citations, count(distinct article) as n_articles from c where law is not null group by 1""")
def bibliography(s, d):
    c = references(s, d).select(law_designation(F.col("target_law")).alias("law"), article_number(F.col("target_article")).alias("article")).where("law is not null")
    return c.groupBy("law").agg(F.count(F.lit(1)).alias("n_citations"), F.countDistinct("article").alias("n_articles"))


@query(f"""with {REFS}, c as (select {_designation('target_law')} as law, {_number('target_article')} as article, lang, confidence from r)
select law, article, count(*) as n_evidence, round(least(avg(confidence) + least(0.05 * count(*), 0.2), 1.0), 6) as reliability, count(distinct lang) > 1 as several_languages from c where law is not null group by 1, 2""")
def evidence_groups(s, d):
    """Reliability of what several sources say: mean confidence with a bonus for each, capped."""
    c = references(s, d).select(law_designation(F.col("target_law")).alias("law"), article_number(F.col("target_article")).alias("article"), "lang", "confidence").where("law is not null")
    return c.groupBy("law", "article").agg(F.count(F.lit(1)).alias("n_evidence"), F.round(F.least(F.avg("confidence") + F.least(0.05 * F.count(F.lit(1)), F.lit(0.2)), F.lit(1.0)), 6).alias("reliability"), (F.countDistinct("lang") > 1).alias("several_languages"))


@query(f"""with {ARTICLES}, x as (select law_uri, number, count(distinct md5(content_full)) as n_texts, count(distinct variant) as n_variants, count(distinct lang) as n_languages from a where law_uri is not null and content_full is not null group by 1, 2) select * from x where n_texts > 1""")
def contradicting_texts(s, d):
    """Provisions of one law and number that read differently, across languages or variants: candidates of contradictions, one row a group instead of pairs."""
    x = articles(s, d).where("law_uri is not null and content_full is not null").groupBy("law_uri", "number").agg(F.countDistinct(F.md5("content_full")).alias("n_texts"), F.countDistinct("variant").alias("n_variants"), F.countDistinct("lang").alias("n_languages"))
    return x.where("n_texts > 1")


@query(f"""with {LAWS}, {LAWNAMES}, {REFS}, k as (select r.source_law, count(*) as n, count(*) filter (names.name is null) as unknown, count(*) filter (regexp_extract(l.in_force_status, '(\\d)/?\\s*$', 1) = '3') as repealed, count(*) filter (context_text is null or context_text = '') as bare
  from r left join names on {_designation('r.target_law')} = names.name left join l on names.target = l.law_uri where source_law is not null and {_designation('r.target_law')} is not null group by 1)
select source_law, n as n_refs, unknown, repealed, n < 2 as too_few, bare > 0.5 * n as mostly_bare, round(greatest(0, least(1, 1.0 - 0.2 * (unknown > 0)::int - 0.05 * repealed + least(0.02 * n, 0.1))), 6)::double as consistency from k""")
def consistency(s, d):
    """Per citing law: unknown and repealed targets, by whatever name they are called, completeness and a consistency score."""
    bare = F.count_if(F.col("context_text").isNull() | (F.col("context_text") == ""))
    r = references(s, d).withColumn("name", law_designation(F.col("target_law"))).where("source_law is not null and name is not null").groupBy("source_law", "name").agg(F.count(F.lit(1)).alias("n"), bare.alias("bare"))
    l = laws(s, d).select(F.col("law_uri").alias("target"), status_digit(F.col("in_force_status")).alias("st"))
    j = r.join(law_names(s, d), "name", "left").join(l, "target", "left")
    n, repealed = F.sum("n"), F.coalesce(F.sum(F.when(F.col("st") == "3", F.col("n"))), F.lit(0))
    unknown = F.coalesce(F.sum(F.when(F.col("target").isNull(), F.col("n"))), F.lit(0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.2 * (unknown > 0).cast("int") - 0.05 * repealed + F.least(0.02 * n, F.lit(0.1))))
    return j.groupBy("source_law").agg(n.alias("n_refs"), unknown.alias("unknown"), repealed.alias("repealed"), (n < 2).alias("too_few"), (F.sum("bare") > 0.5 * n).alias("mostly_bare"), F.round(score, 6).alias("consistency"))
