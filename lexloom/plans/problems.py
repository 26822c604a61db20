"""Queries of the numbered data problems over the law collection, with equivalent SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.uris import article_number, canonical_uri, law_designation, law_of_uri, status_digit
from lexloom.operators.dedup import latest_delivery
from lexloom.operators.hierarchy import descendants, hierarchy
from lexloom.operators.history import snapshot_changes, snapshot_history
from lexloom.operators.intervals import LAST_DAY, covered_spans, day_number, day_string
from lexloom.operators.nested import object_table, schema_tables, shred, subject_values, value_table
from lexloom.operators.references import failed_references, orphan_report
from lexloom.session import dealt, table

OPEN_END = "9999-12-31"


# ---- 1: history of changing attributes ---------------------------------------------------------


def law_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per law and snapshot the state that the latest delivery tells; an end in year 9999 is open."""
    raw = table(spark, sf_dir, "law_snapshots").select(
        canonical_uri(F.col("uri")).alias("law_uri"), "snapshot_date", status_digit(F.col("in_force_status")).alias("status"),
        "date_applicable", F.when(F.year("date_end_applicable") < 9999, F.col("date_end_applicable")).alias("date_end_applicable"), "loaded_at",
    )
    return latest_delivery(raw, ["law_uri", "snapshot_date"], "loaded_at", STATE)


STATE = ["status", "date_applicable", "date_end_applicable"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = snapshot_history(law_states(spark, sf_dir), "law_uri", "snapshot_date", STATE, carry=["status"])
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return periods.select("law_uri", iso(F.col("valid_from")).alias("valid_from"), F.coalesce(iso(F.col("valid_to")), F.lit(OPEN_END)).alias("valid_to"))


def p1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted, changed and deleted laws per snapshot, when a law that a snapshot lacks is deleted."""
    events = snapshot_changes(law_states(spark, sf_dir), "law_uri", "snapshot_date", STATE, carry=["status"], close_missing=True)
    return events.groupBy(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "change").agg(F.count(F.lit(1)).alias("n_laws"))


# ---- 2: hierarchies ----------------------------------------------------------------------------


def law_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_uri, parent_uri) of taxonomy levels and articles, by the latest delivery of each."""
    levels = table(spark, sf_dir, "taxonomy_levels").select(canonical_uri(F.col("uri")).alias("node_uri"), canonical_uri(F.col("parent_uri")).alias("parent_uri"), "loaded_at")
    articles = table(spark, sf_dir, "article_nodes").select(canonical_uri(F.col("uri")).alias("node_uri"), canonical_uri(F.col("parent_id")).alias("parent_uri"), "loaded_at")
    return latest_delivery(levels.unionByName(articles).where("node_uri is not null"), ["node_uri"], "loaded_at", ["parent_uri"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(law_tree_links(spark, sf_dir), "node_uri", "parent_uri")
    return tree.select("node_uri", F.coalesce("root", F.lit("")).alias("root_uri"), F.col("depth").alias("node_depth"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(law_tree_links(spark, sf_dir), "node_uri", "parent_uri", paths=True)
    return tree.select("node_uri", F.array_join("path", " > ").alias("node_path"), "cyclic")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (ancestor, descendant) pairs with their distance."""
    return descendants(hierarchy(law_tree_links(spark, sf_dir), "node_uri", "parent_uri", paths=True), "node_uri")


def p2_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy(law_tree_links(spark, sf_dir), "node_uri", "parent_uri", paths=True)
    return descendants(tree, "node_uri").groupBy(F.col("ancestor").alias("node_uri")).agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


# ---- 3: references to missing records ----------------------------------------------------------


def reference_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, first_seen, deleted_at) of all laws, articles and language variants, under every name they have.

    Keys: ``L|<law>``, ``A|<law>|<number>``, ``V|<variant uri>``, where a law is named by URI,
    number or abbreviation. first_seen is null for what was always there.
    """
    laws = table(spark, sf_dir, "law_nodes").select(law_of_uri(canonical_uri(F.col("uri"))).alias("law"), law_designation(F.col("sr_number")).alias("sr"), "deleted_at", "loaded_at").where("law is not null")
    codes = table(spark, sf_dir, "code_articles").select(law_of_uri(canonical_uri(F.col("law_uri"))).alias("law"), law_designation(F.col("sr_number")).alias("sr"), law_designation(F.col("abbreviation")).alias("abbr"), article_number(F.col("number")).alias("number")).where("law is not null")
    articles = table(spark, sf_dir, "article_nodes").select(law_of_uri(canonical_uri(F.col("law_uri"))).alias("law"), article_number(F.col("number")).alias("number"), "loaded_at").where("law is not null and number is not null")
    variants = table(spark, sf_dir, "law_language_variants").select(canonical_uri(F.col("uri")).alias("uri"), "deleted_at", "loaded_at").where("uri is not null")

    def times(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.min("loaded_at").alias("first_seen"), F.max(F.struct("loaded_at", "deleted_at"))["deleted_at"].alias("deleted_at"))

    never = F.lit(None).cast("timestamp_ntz")
    names = laws.select("law", F.col("sr").alias("name")).unionByName(codes.select("law", F.explode(F.array("sr", "abbr")).alias("name"))).where("name is not null")
    names = names.groupBy("law").agg(F.collect_set("name").alias("names"))  # a law's few numbers and abbreviations
    law_times = times(laws, "law").unionByName(codes.select("law", never.alias("first_seen"), never.alias("deleted_at")).distinct())
    article_times = articles.groupBy("law", "number").agg(F.min("loaded_at").alias("first_seen")).unionByName(codes.where("number is not null").select("law", "number", never.alias("first_seen")))
    every = F.array_union(F.array("law"), F.coalesce("names", F.array().cast("array<string>")))
    named = lambda df: df.join(names, "law", "left").withColumn("name", F.explode(every)).drop("names")

    keyed = (
        named(law_times).select(F.concat(F.lit("L|"), "name").alias("key"), "first_seen", "deleted_at")
        .unionByName(named(article_times).select(F.concat_ws("|", F.lit("A"), "name", "number").alias("key"), "first_seen", never.alias("deleted_at")))
        .unionByName(times(variants, "uri").select(F.concat(F.lit("V|"), "uri").alias("key"), "first_seen", "deleted_at"))
    )
    # several laws of one number: a reference to it holds if one of them does
    some_null = lambda c: F.when(F.count(F.lit(1)) == F.count(c), 1)
    return keyed.groupBy("key").agg(F.when(some_null("first_seen") == 1, F.min("first_seen")).alias("first_seen"), F.when(some_null("deleted_at") == 1, F.max("deleted_at")).alias("deleted_at"))


def law_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, row_key, ref_field, key, at): what html_references and article_nodes refer to."""
    html = dealt(table(spark, sf_dir, "html_references").select("ref_id", "target_law", "target_article", "extracted_at")).select(F.col("ref_id").cast("string").alias("row_key"), law_designation(F.col("target_law")).alias("law"), article_number(F.col("target_article")).alias("number"), F.col("extracted_at").alias("at"))
    both = F.array(
        F.struct(F.lit("target_law").alias("ref_field"), F.concat(F.lit("L|"), "law").alias("key")),
        F.struct(F.lit("target_article").alias("ref_field"), F.concat(F.lit("A|"), "law", F.lit("|"), "number").alias("key")),
    )
    html = html.select(F.lit("html_references").alias("source_table"), "row_key", F.explode(both).alias("r"), "at").select("source_table", "row_key", "r.ref_field", "r.key", "at")
    raw = table(spark, sf_dir, "article_nodes").select(canonical_uri(F.col("uri")).alias("row_key"), canonical_uri(F.col("law_language_variant_uri")).alias("variant"), "loaded_at").where("row_key is not null")
    articles = latest_delivery(raw, ["row_key"], "loaded_at", ["variant"])
    articles = articles.select(F.lit("article_nodes").alias("source_table"), "row_key", F.lit("law_language_variant_uri").alias("ref_field"), F.concat(F.lit("V|"), "variant").alias("key"), F.col("loaded_at").alias("at"))
    return html.unionByName(articles).where("key is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = failed_references(law_references(spark, sf_dir), reference_parents(spark, sf_dir), "at")
    # one case a row: an article counts only where its law is no case; repeated rows fall together
    law_first = F.struct((F.col("ref_field") == "target_article").alias("later"), "ref_field", "reason", F.date_format("at", "yyyy-MM").alias("period_month"))
    cases = failed.groupBy("source_table", "row_key").agg(F.min(law_first).alias("c"))
    return cases.select("source_table", "row_key", "c.ref_field", "c.reason", "c.period_month")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p3_found(spark, sf_dir), ["source_table", "ref_field", "reason", "period_month"])


# ---- 4: overlapping and gapped intervals -------------------------------------------------------


def version_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law_uri, from_day, to_day) of the versions, by the latest delivery of each version."""
    raw = table(spark, sf_dir, "version_nodes").select(canonical_uri(F.col("uri")).alias("uri"), canonical_uri(F.col("law_uri")).alias("law_uri"), "date_applicable", "date_end_applicable", "loaded_at").where("uri is not null")
    last = latest_delivery(raw, ["uri"], "loaded_at", ["law_uri", "date_applicable", "date_end_applicable"])
    end = F.when(F.year("date_end_applicable") < 9999, day_number(F.col("date_end_applicable"))).otherwise(F.lit(LAST_DAY))
    return last.select("law_uri", day_number(F.col("date_applicable")).alias("from_day"), end.alias("to_day"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = covered_spans(version_spans(spark, sf_dir), ["law_uri"], "from_day", "to_day")
    return spans.select("law_uri", "span_kind", day_string(F.col("from_day")).alias("from_date"), day_string(F.col("to_day")).alias("to_date"))


# ---- 5: nested records -------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_delivery(table(spark, sf_dir, "fedlex_json"), ["record_id"], "loaded_at", ["payload"])


def record_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_values(records(spark, sf_dir), "record_id", "payload")


def record_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(records(spark, sf_dir), "record_id", "payload")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_values(spark, sf_dir)


def p5_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_table(record_nodes(spark, sf_dir))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of scalars, each with the label of what holds it and its schema path."""
    return value_table(record_nodes(spark, sf_dir))


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the records fall into, one row each."""
    return schema_tables(record_nodes(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p2_found, p2_paths, p2_descendants, p2_subtrees, p3_found, p3_report, p4_found, p5_found, p5_objects, p5_values, p5_tables)}


# ---- equivalent SQL ----------------------------------------------------------------------------


def _uri(c: str) -> str:
    trimmed = rf"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '/$', '')"
    return rf"""case when {trimmed} = '' then null
        when regexp_matches({trimmed}, '^(?i)https?://') then 'https://' || lower(regexp_extract({trimmed}, '^(?i)https?://([^/]+)', 1)) || regexp_replace({trimmed}, '^(?i)https?://[^/]+', '')
        else {trimmed} end"""


def _law(c: str) -> str:
    return rf"coalesce(nullif(regexp_extract({_uri(c)}, '^(https://[^/]+/eli/cc/[^/]+/[^/]+)', 1), ''), {_uri(c)})"


def _designation(c: str) -> str:
    number = rf"regexp_extract(regexp_replace({c}, '\s+', '', 'g'), '^(?i)(?:SR|RS)?([0-9][0-9A-Za-z.]*)$', 1)"
    return rf"""case when {c} is null or trim({c}) = '' then null when regexp_matches(trim({c}), '^(?i)https?://') then {_law(c)}
        when {number} <> '' then 'sr:' || {number} else 'abbr:' || upper(trim({c})) end"""


def _number(c: str) -> str:
    cut = rf"regexp_replace(lower({c}), '\s*(\babs\b|\bal\b|\bcpv\b|\bpara\b)[.\s].*$', '')"
    return rf"nullif(regexp_replace(regexp_replace({cut}, '^\s*art(\.|\b)', ''), '[\s.]+', '', 'g'), '')"


_STATES = rf"""
  d as (select {_uri("uri")} as law_uri, snapshot_date, nullif(regexp_extract(in_force_status, '(\d)/?\s*$', 1), '') as status, date_applicable,
      case when year(date_end_applicable) < 9999 then date_end_applicable end as date_end, loaded_at from law_snapshots),
  l as (select *, row_number() over (partition by law_uri, snapshot_date order by loaded_at desc, status desc nulls last, date_applicable desc nulls last, date_end desc nulls last) as rn from d),
  s as (select law_uri, snapshot_date, last_value(status ignore nulls) over (partition by law_uri order by snapshot_date rows between unbounded preceding and current row) as status, date_applicable, date_end from l where rn = 1)"""

_LINKS = rf"""
  u as (select {_uri("uri")} as node, {_uri("parent_uri")} as parent, loaded_at from taxonomy_levels union all select {_uri("uri")}, {_uri("parent_id")}, loaded_at from article_nodes),
  l as (select *, row_number() over (partition by node order by loaded_at desc, parent desc nulls last) as rn from u where node is not null),
  n as (select l.node, p.node as parent from l left join (select node from l where rn = 1) p on l.parent = p.node where l.rn = 1),
  t as (select node, node as root, 0 as depth, node as path from n where parent is null
        union all select n.node, t.root, t.depth + 1, t.path || ' > ' || n.node from n join t on n.parent = t.node)"""

_FAILED = rf"""
  laws as (select {_law("uri")} as law, {_designation("sr_number")} as sr, deleted_at, loaded_at from law_nodes),
  codes as (select distinct {_law("law_uri")} as law, {_designation("sr_number")} as sr, {_designation("abbreviation")} as abbr, {_number("number")} as number from code_articles),
  names as (select law, sr as name from laws where sr is not null union select law, sr from codes union select law, abbr from codes union select law, law from laws union select law, law from codes),
  lt as (select law, min(loaded_at) as first_seen, arg_max(coalesce(deleted_at, timestamp '9999-01-01'), loaded_at) as deleted_at from laws group by 1
         union all select distinct law, timestamp '0001-01-01', timestamp '9999-01-01' from codes),
  arts as (select {_law("law_uri")} as law, {_number("number")} as number, min(loaded_at) as first_seen from article_nodes group by 1, 2 union all select law, number, timestamp '0001-01-01' from codes),
  lp as (select name, min(first_seen) as first_seen, max(deleted_at) as deleted_at from lt join names using (law) group by 1),
  an as (select law, name from names union select law, law from arts),
  ap as (select name, number, min(first_seen) as first_seen from arts join an using (law) group by 1, 2),
  vp as (select {_uri("uri")} as uri, min(loaded_at) as first_seen, arg_max(coalesce(deleted_at, timestamp '9999-01-01'), loaded_at) as deleted_at from law_language_variants group by 1),
  h as (select distinct ref_id::varchar as row_key, {_designation("target_law")} as law, {_number("target_article")} as number, extracted_at as t_ref from html_references),
  hl as (select h.*, case when h.law is null then null when lp.name is null then 'missing' when lp.deleted_at <= t_ref then 'deleted' when lp.first_seen > t_ref then 'late' end as reason
         from h left join lp on h.law = lp.name),
  ha as (select hl.row_key, hl.t_ref, case when ap.name is null then 'missing' when ap.first_seen > t_ref then 'late' end as reason
         from hl left join ap on hl.law = ap.name and hl.number = ap.number where hl.reason is null and hl.law is not null and hl.number is not null),
  a0 as (select {_uri("uri")} as row_key, {_uri("law_language_variant_uri")} as variant, loaded_at as t_ref from article_nodes),
  a1 as (select *, row_number() over (partition by row_key order by t_ref desc, variant desc nulls last) as rn from a0 where row_key is not null),
  av as (select row_key, t_ref, case when vp.uri is null then 'missing' when vp.deleted_at <= t_ref then 'deleted' when vp.first_seen > t_ref then 'late' end as reason from a1 left join vp on a1.variant = vp.uri where rn = 1 and variant is not null),
  f as (select 'html_references' as source_table, row_key, 'target_law' as ref_field, reason, t_ref from hl union all select 'html_references', row_key, 'target_article', reason, t_ref from ha
        union all select 'article_nodes', row_key, 'law_language_variant_uri', reason, t_ref from av),
  cases as (select source_table, row_key, ref_field, reason, strftime(t_ref, '%Y-%m') as period_month from f where reason is not null)"""

# nodes of the records: objects with uri are subjects of what stands below them, facets beside data belong to it
_SUBJECTS = """
  r0 as (select record_id, payload, row_number() over (partition by record_id order by loaded_at desc, payload desc nulls last) as rn from fedlex_json),
  n as (select record_id, payload::json as v, null::varchar as subject, null::varchar as section, null::varchar as entry, null::varchar as name, true as is_doc from r0 where rn = 1 and json_valid(payload)
    union all select record_id, coalesce(m, v->c), subject, section, entry, name, is_doc from (
      select record_id, v, case when json_type(v) = 'ARRAY' then '$[' || k || ']' else '$."' || k || '"' end as c,
        case when json_type(v) = 'OBJECT' and is_doc and k = 'data' and json_type(v->'data') = 'OBJECT' and json_type(v->'facets') is not null and json_type(v->'data'->'facets') is null
          then json_merge_patch(v->'data', json_object('facets', v->'facets')) end as m,
        case when json_type(v) = 'ARRAY' then subject when own then v->>'uri' else subject end as subject, case when json_type(v) = 'OBJECT' and own then k else section end as section,
        case when json_type(v) = 'ARRAY' then entry when own then null else coalesce(entry, case when section is not null then k end) end as entry, case when json_type(v) = 'ARRAY' then name else k end as name, json_type(v) = 'ARRAY' and is_doc as is_doc
      from (select *, case when json_type(v) = 'ARRAY' then unnest(range(json_array_length(v)::bigint)::varchar[]) else unnest(json_keys(v)) end as k,
          json_type(v) = 'OBJECT' and json_type(v->'uri') = 'VARCHAR' and v->>'uri' <> '' and not (is_doc and coalesce(json_type(v->'data') = 'OBJECT', false)) as own from n where json_type(v) in ('ARRAY', 'OBJECT'))
      where not (json_type(v) = 'OBJECT' and is_doc and k = 'facets' and json_type(v->'data') = 'OBJECT' and json_type(v->'data'->'facets') is null))),
  f as (select distinct record_id, subject as subject_uri, section as section_name, entry as entry_name,
      case when json_type(v) = 'OBJECT' then case when json_type(v->'uri') = 'VARCHAR' then v->>'uri' end else v->>'$' end as entry_value
    from n where subject is not null and section in ('attributes', 'references', 'facets') and entry is not null and entry <> 'xml:lang' and json_type(v) <> 'ARRAY' and (json_type(v) = 'OBJECT' or name <> 'xml:lang')),
  x as (select * from f where entry_value is not null and entry_value <> '')"""

ORACLES = {
    "p5_found": f"with recursive {_SUBJECTS} select * from x",
    "p1_found": f"""with {_STATES},
  c as (select *, lag(snapshot_date) over w as before, lag(status) over w as s0, lag(date_applicable) over w as a0, lag(date_end) over w as e0 from s window w as (partition by law_uri order by snapshot_date)),
  e as (select * from c where before is null or status is distinct from s0 or date_applicable is distinct from a0 or date_end is distinct from e0)
select law_uri, strftime(snapshot_date, '%Y-%m-%d') as valid_from, coalesce(strftime(lead(snapshot_date) over (partition by law_uri order by snapshot_date), '%Y-%m-%d'), '9999-12-31') as valid_to from e""",
    "p1_changes": f"""with {_STATES},
  cal as (select snapshot_date, row_number() over (order by snapshot_date) as n, lead(snapshot_date) over (order by snapshot_date) as next_date from (select distinct snapshot_date from s)),
  r as (select s.*, n, next_date from s join cal using (snapshot_date)),
  j as (select coalesce(a.snapshot_date, b.next_date) as d, case when b.law_uri is null then 'inserted' when a.law_uri is null then 'deleted'
        when a.status is distinct from b.status or a.date_applicable is distinct from b.date_applicable or a.date_end is distinct from b.date_end then 'changed' end as change
        from r a full join r b on a.law_uri = b.law_uri and a.n = b.n + 1)
select strftime(d, '%Y-%m-%d') as snapshot_date, change, count(*) as n_laws from j where change is not null and d is not null group by 1, 2""",
    "p2_found": f"with recursive {_LINKS} select n.node as node_uri, coalesce(t.root, '') as root_uri, coalesce(t.depth, -1)::bigint as node_depth from n left join t using (node)",
    "p2_paths": f"with recursive {_LINKS} select n.node as node_uri, coalesce(t.path, '') as node_path, t.node is null as cyclic from n left join t using (node)",
    "p2_descendants": f"""with recursive {_LINKS}, a as (select node, unnest(string_split(path, ' > ')[:-2]) as anc, unnest(generate_series(depth, 1, -1)) as dist from t where depth > 0)
select anc as ancestor, node as descendant, dist::bigint as distance from a""",
    "p2_subtrees": f"""with recursive {_LINKS}, a as (select node, unnest(string_split(path, ' > ')[:-2]) as anc, unnest(generate_series(depth, 1, -1)) as dist from t where depth > 0)
select anc as node_uri, count(*) as n_descendants, max(dist)::bigint as height from a group by 1""",
    "p3_found": f"with {_FAILED} select * from cases",
    "p3_report": f"with {_FAILED} select source_table, ref_field, reason, period_month, count(*) as n_refs from cases group by all",
    "p4_found": f"""with d as (select {_uri("uri")} as uri, {_uri("law_uri")} as law_uri, date_applicable as a, date_end_applicable as b, loaded_at from version_nodes),
  l as (select *, row_number() over (partition by uri order by loaded_at desc, law_uri desc nulls last, a desc nulls last, b desc nulls last) as rn from d where uri is not null),
  v as (select law_uri, a::date as a, case when year(b) < 9999 then b::date else date '9999-12-31' end as b from l where rn = 1 and law_uri is not null),
  o as (select *, max(b) over (partition by law_uri order by a, b rows between unbounded preceding and 1 preceding) as far from v where a < b),
  g as (select *, sum(case when far >= a then 0 else 1 end) over (partition by law_uri order by a, b rows unbounded preceding) as island from o),
  p as (select law_uri, island, min(a) as a, max(b) as b from g group by 1, 2),
  r as (select law_uri, 'period' as span_kind, a, b from p union all select law_uri, 'gap', b, lead(a) over (partition by law_uri order by a) from p)
select law_uri, span_kind, strftime(a, '%Y-%m-%d') as from_date, strftime(b, '%Y-%m-%d') as to_date from r where b is not null""",
}
