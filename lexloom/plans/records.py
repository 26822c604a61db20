"""Queries that carry whole records: upserts and edges of every label, projections of linked data, reports, sessions as trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.sr import DOMAINS, normalize_sr
from lexloom.functions.uris import canonical_uri, law_designation, status_digit
from lexloom.operators import graph as G
from lexloom.operators import retrieval as R
from lexloom.operators import temporal as T
from lexloom.operators.dedup import latest_delivery
from lexloom.plans import catalogue as C
from lexloom.plans import problems as P
from lexloom.plans import texts as X
from lexloom.plans.problems import _designation, _uri
from lexloom.plans.reasoning import _EDGES, _VALUES, json_edges
from lexloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# ---- nodes and edges of every label ----

# label, table, title, number and language columns
_LABELS = [
    ("Law", "law_nodes", "title_de", "sr_number", "null"), ("Version", "version_nodes", "null", "version_number", "null"), ("LawLanguageVariant", "law_language_variants", "title", "sr_number", "lang"),
    ("Article", "article_nodes", "title", "number", "lang"), ("TaxonomyLevel", "taxonomy_levels", "title_de", "number", "null"),
]
_ALL = " union all ".join(f"select '{label}|' || {_uri('uri')} as node, {title}::varchar as title, {number}::varchar as number, {lang}::varchar as lang, loaded_at from {tab} where {_uri('uri')} is not null" for label, tab, title, number, lang in _LABELS)
_HALF = "select * from (select *, row_number() over (partition by node order by loaded_at desc, title desc nulls last, number desc nulls last, lang desc nulls last) as rn from raw where {}) where rn = 1"


def _deliveries(s, d):
    parts = [
        table(s, d, tab).select(F.concat(F.lit(f"{label}|"), canonical_uri(F.col("uri"))).alias("node"), F.expr(title).cast("string").alias("title"), F.expr(number).cast("string").alias("number"), F.expr(lang).cast("string").alias("lang"), "loaded_at")
        for label, tab, title, number, lang in _LABELS
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.where("node is not null")


@query(f"""with raw as ({_ALL}), o as ({_HALF.format("loaded_at < timestamp '2024-01-01'")}), n as ({_HALF.format("loaded_at >= timestamp '2024-01-01'")})
select coalesce(n.node, o.node) as node, coalesce(n.title, o.title) as title, coalesce(n.number, o.number) as number, coalesce(n.lang, o.lang) as lang, case when o.node is null then 'created' when n.node is null then 'kept' else 'merged' end as upsert_state from n full join o on n.node = o.node""")
def upsert_nodes(s, d):
    """Keyed upsert of the nodes of every label: what came later fills or replaces what was there."""
    raw, cols = _deliveries(s, d), ["title", "number", "lang"]
    half = lambda cond: latest_delivery(raw.where(cond), ["node"], "loaded_at", cols).drop("loaded_at")
    return G.upsert(half("loaded_at < timestamp_ntz'2024-01-01 00:00:00'"), half("loaded_at >= timestamp_ntz'2024-01-01 00:00:00'"), "node")


@query(f"with raw as ({_ALL}) select split_part(node, '|', 1) as label, count(*) as n_rows, count(distinct node) as n_nodes, count(*) filter (title is null) as without_title, count(*) filter (number is null) as without_number from raw group by 1")
def schema_report(s, d):
    """Per label rows, nodes and what is missing."""
    miss = lambda c: F.count_if(F.col(c).isNull()).alias(f"without_{c}")
    return _deliveries(s, d).groupBy(F.split_part("node", F.lit("|"), F.lit(1)).alias("label")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("node").alias("n_nodes"), miss("title"), miss("number"))


@query(f"""with {C.VERSIONS}, {C.VARIANTS}, {C.ARTICLES}, {C.LEVELS} select law_uri as src, uri as dst, 'HAS_VERSION' as type, strftime(start, '%Y-%m-%d') as property from v union all select law_uri, uri, 'HAS_LANGUAGE', lang from g where law_uri is not null
union all select variant, uri, 'HAS_ARTICLE', art_position::varchar from a where variant is not null union all select p.uri, c.uri, 'CONTAINS', c.number from t c join t p on c.parent_uri = p.uri""")
def typed_edges(s, d):
    """Edges of all types in one table, each with its own property: date, language, position or number."""
    edge = lambda df, src, kind, prop: df.select(F.col(src).alias("src"), F.col("uri").alias("dst"), F.lit(kind).alias("type"), prop.cast("string").alias("property")).where("src is not null")
    t = C.levels(s, d)
    inside = t.join(t.select(F.col("uri").alias("parent_uri")), "parent_uri")
    return (
        edge(C.versions(s, d), "law_uri", "HAS_VERSION", F.date_format("start", "yyyy-MM-dd")).unionByName(edge(C.variants(s, d), "law_uri", "HAS_LANGUAGE", F.col("lang")))
        .unionByName(edge(C.articles(s, d), "variant", "HAS_ARTICLE", F.col("art_position"))).unionByName(edge(inside, "parent_uri", "CONTAINS", F.col("number")))
    )


@query(f"with {C.LEVELS} select lower(p.level_type) as parent_kind, lower(c.level_type) as child_kind, count(*) as n from t c join t p on c.parent_uri = p.uri group by 1, 2")
def containment_kinds(s, d):
    """Which kinds of level contain which, skipped ones as well, such as a section right below a book."""
    t = C.levels(s, d)
    p = t.select(F.col("uri").alias("parent_uri"), F.lower("level_type").alias("parent_kind"))
    return t.join(p, "parent_uri").groupBy("parent_kind", F.lower("level_type").alias("child_kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {C.LEVELS} select n.uri, n.parent_uri, p.title_de as parent_title, c.uri as child, c.title_de as child_title from t n left join t p on n.parent_uri = p.uri left join t c on c.parent_uri = n.uri")
def node_relatives(s, d):
    """Each level with its parent and each of its children, one row a child; the lists stay rows, however long."""
    t = C.levels(s, d)
    p = t.select(F.col("uri").alias("parent_uri"), F.col("title_de").alias("parent_title"))
    c = t.where("parent_uri is not null").select(F.col("parent_uri").alias("uri"), F.col("uri").alias("child"), F.col("title_de").alias("child_title"))
    return t.select("uri", "parent_uri").join(p, "parent_uri", "left").join(c, "uri", "left").select("uri", "parent_uri", "parent_title", "child", "child_title")


_H = "case when sr like '101%' then 0.5 when sr like '210%' or sr like '220%' then 0.7 when sr is null then 1.0 else 0.9 end"


@query(f"""with {C.EDGES}, n as (select law_uri, {C.SR_SQL} as sr from l) select e.src, e.dst, e.type, round(0.5 / case e.type when 'REFERENCES' then 1.0 else 1.5 end * (2 - {_H}), 6)::double as path_score from e left join n on e.src = n.law_uri""")
def edge_scores(s, d):
    """Path scores of the direct ways between laws, versions and variants, by the weight of the edge's type and the rank of the law."""
    n = C.laws(s, d).select(F.col("law_uri").alias("src"), normalize_sr(F.col("sr_number")).alias("sr"))
    h = F.when(F.col("sr").like("101%"), 0.5).when(F.col("sr").like("210%") | F.col("sr").like("220%"), 0.7).when(F.col("sr").isNull(), 1.0).otherwise(0.9)
    return C.law_edges(s, d).join(n, "src", "left").select("src", "dst", "type", F.round(R.path_score(F.lit(1), F.array("type"), h), 6).alias("path_score"))


# ---- files and linked data ----


@query("""with j as (select regexp_extract(file_path, '^(/eli/[^/]+/[^/]+/[^/.]+)', 1) as k, count(distinct file_path) as n_json from fedlex_json group by 1), h as (select regexp_extract(source_file, '^(/eli/[^/]+/[^/]+/[^/.]+)', 1) as k, count(distinct source_file) as n_html, min(source_file) as first_html, max(source_file) as last_html from html_references group by 1)
select j.k as law_key, n_json, coalesce(n_html, 0) as n_html, first_html, last_html from j left join h using (k) where k <> ''""")
def law_files(s, d):
    """Files of each law: how many records, how many pages, the first and last page."""
    key = lambda c: F.regexp_extract(c, r"^(/eli/[^/]+/[^/]+/[^/.]+)", 1).alias("law_key")
    j = table(s, d, "fedlex_json").groupBy(key("file_path")).agg(F.count_distinct("file_path").alias("n_json"))
    h = table(s, d, "html_references").groupBy(key("source_file")).agg(F.count_distinct("source_file").alias("n_html"), F.min("source_file").alias("first_html"), F.max("source_file").alias("last_html"))
    return j.where("law_key <> ''").join(h, "law_key", "left").select("law_key", "n_json", F.coalesce("n_html", F.lit(0)).alias("n_html"), "first_html", "last_html")


_FIELDS = ["dateDocument", "dateEntryInForce", "dateNoLongerInForce", "dateApplicability", "dateEndApplicability", "inForceStatus", "typeDocument", "historicalId", "basicAct", "classifiedByTaxonomyEntry", "responsibilityOf", "isRealizedBy", "isEmbodiedBy", "isMemberOf", "language", "title", "titleShort", "titleAlternative", "format", "impacts", "legalResourceGenre", "publicationDate", "sequenceInTheYearOfPublication", "memorialPage"]


@query(f"{_VALUES} select subject_uri, {', '.join(f"count(*) filter (entry_name = '{n}') as n_{n}, min(entry_value) filter (entry_name = '{n}') as {n}" for n in _FIELDS)} from x group by 1")
def json_projection(s, d):
    """The properties of each subject of the linked data as columns: the first value and how many there are."""
    at = lambda n: F.col("entry_name") == n
    return P.record_values(s, d).groupBy("subject_uri").agg(*[c for n in _FIELDS for c in (F.count_if(at(n)).alias(f"n_{n}"), F.min(F.when(at(n), F.col("entry_value"))).alias(n))])


@query(f"{_VALUES} select regexp_replace(subject_uri, '/(de|fr|it|rm|en)$', '') as work_uri, regexp_extract(subject_uri, '/(de|fr|it|rm|en)$', 1) as lang, min(entry_value) filter (entry_name = 'title') as title, min(entry_value) filter (entry_name = 'titleShort') as abbreviation from x where regexp_matches(subject_uri, '/(de|fr|it|rm|en)$') group by 1, 2")
def json_titles(s, d):
    """Titles and abbreviations by language, from the expressions of each work."""
    v = P.record_values(s, d).where(F.col("subject_uri").rlike("/(de|fr|it|rm|en)$"))
    of = lambda n: F.min(F.when(F.col("entry_name") == n, F.col("entry_value")))
    return v.groupBy(F.regexp_replace("subject_uri", "/(de|fr|it|rm|en)$", "").alias("work_uri"), F.regexp_extract("subject_uri", "/(de|fr|it|rm|en)$", 1).alias("lang")).agg(of("title").alias("title"), of("titleShort").alias("abbreviation"))


@query(f"{_VALUES}, k as (select subject_uri, min(entry_value) filter (entry_name = 'dateApplicability') as starts, min(entry_value) filter (entry_name = 'dateEndApplicability') as ends, min(entry_value) filter (entry_name = 'isMemberOf') as law from x group by 1) select subject_uri as version_uri, law, starts, ends from k where starts is not null or law is not null")
def json_versions(s, d):
    """Version nodes of the linked data, with their law and dates."""
    of = lambda n: F.min(F.when(F.col("entry_name") == n, F.col("entry_value")))
    k = P.record_values(s, d).groupBy(F.col("subject_uri").alias("version_uri")).agg(of("isMemberOf").alias("law"), of("dateApplicability").alias("starts"), of("dateEndApplicability").alias("ends"))
    return k.where("starts is not null or law is not null")


@query(f"{_VALUES} select subject_uri as act_uri, case when contains(subject_uri, '/fga/') then 'gazette' else 'official' end as series, count(*) filter (entry_name = 'impacts') as n_impacts, min(entry_value) filter (entry_name = 'dateDocument') as document_date from x where contains(subject_uri, '/oc/') or contains(subject_uri, '/fga/') group by 1, 2")
def json_acts(s, d):
    """Act nodes of the linked data, with the publication series and what they change."""
    v = P.record_values(s, d).where(F.col("subject_uri").contains("/oc/") | F.col("subject_uri").contains("/fga/"))
    series = F.when(F.col("subject_uri").contains("/fga/"), "gazette").otherwise("official")
    return v.groupBy(F.col("subject_uri").alias("act_uri"), series.alias("series")).agg(F.count_if(F.col("entry_name") == "impacts").alias("n_impacts"), F.min(F.when(F.col("entry_name") == "dateDocument", F.col("entry_value"))).alias("document_date"))


@query(f"{_EDGES}, described as (select distinct subject_uri from x) select dst as stub_uri, count(*) as n_edges, min(type) as first_type from e where dst not in (select subject_uri from described) group by 1")
def json_stubs(s, d):
    """Targets of edges of the linked data that no record describes: nodes to be made as stubs."""
    known = P.record_values(s, d).select(F.col("subject_uri").alias("dst")).distinct()
    return json_edges(s, d).join(known, "dst", "left_anti").groupBy(F.col("dst").alias("stub_uri")).agg(F.count(F.lit(1)).alias("n_edges"), F.min("type").alias("first_type"))


@query(f"{_EDGES} select 'node' as kind, section_name as type, count(distinct subject_uri) as n from x group by 2 union all select 'edge', type, count(*) from e group by 2")
def extraction_counts(s, d):
    """What the linked data gives: subjects per section and edges per type."""
    nodes = P.record_values(s, d).groupBy(F.lit("node").alias("kind"), F.col("section_name").alias("type")).agg(F.count_distinct("subject_uri").alias("n"))
    return nodes.unionByName(json_edges(s, d).groupBy(F.lit("edge").alias("kind"), "type").agg(F.count(F.lit(1)).alias("n")))


_DATES = ["date_document", "date_entry_in_force", "date_no_longer_in_force"]


def _date_sql(c: str) -> str:
    return f"""strftime(case when regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then try_strptime(left({c}, 10), '%Y-%m-%d') when regexp_matches({c}, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}$') then try_strptime({c}, '%d.%m.%Y')
      when regexp_matches({c}, '^\\d{{8}}$') then try_strptime({c}, '%Y%m%d') when regexp_matches({c}, '^\\d{{4}}/\\d{{2}}/\\d{{2}}$') then try_strptime({c}, '%Y/%m/%d') end, '%Y-%m-%d') as {c}"""


@query(f"with {C.LAWS} select law_uri, {', '.join(map(_date_sql, _DATES))} from l")
def law_date_fields(s, d):
    """All dates of a law in one spelling."""
    return C.laws(s, d).select("law_uri", *[F.date_format(T.parse_any_date(F.col(c)), "yyyy-MM-dd").alias(c) for c in _DATES])


@query(f"""with u as (select distinct {_uri('target_law')} as uri from html_references where {_uri('target_law')} like 'https:%') select uri, regexp_replace(uri, '/(html|pdf|xml|docx|json)$', '') as document_uri, regexp_replace(regexp_replace(uri, '/(html|pdf|xml|docx|json)$', ''), '/(de|fr|it|rm|en)$', '') as source_uri,
  case when regexp_matches(uri, '/(html|pdf|xml|docx|json)$') then 'Manifestation' when regexp_matches(uri, '/(de|fr|it|rm|en)$') then 'Expression' when regexp_matches(uri, '/\\d{{8}}$') then 'Version' else 'Work' end as level from u""")
def uri_levels(s, d):
    """Each cited URI with the document and source it is of, and its level: work, version, expression or manifestation."""
    u = table(s, d, "html_references").select(canonical_uri(F.col("target_law")).alias("uri")).where("uri like 'https:%'").distinct()
    form, lang = "/(html|pdf|xml|docx|json)$", "/(de|fr|it|rm|en)$"
    level = F.when(F.col("uri").rlike(form), "Manifestation").when(F.col("uri").rlike(lang), "Expression").when(F.col("uri").rlike(r"/\d{8}$"), "Version").otherwise("Work")
    document = F.regexp_replace("uri", form, "")
    return u.select("uri", document.alias("document_uri"), F.regexp_replace(document, lang, "").alias("source_uri"), level.alias("level"))


_DOMAIN_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in DOMAINS.items()) + "}"


@query(f"""with {C.LAWS}, n as (select distinct {C.SR_SQL} as sr from l), p as (select split_part(sr, '.', 1) as a from n where sr is not null) select distinct a[1] as domain_id, coalesce({_DOMAIN_SQL}[a[1]], 'unknown') as domain_name, a as chapter_id, array_to_string(string_split(a, ''), '.') as dotted from p""")
def taxonomy_names(s, d):
    """Chapters of the numbers in use with the name of their domain and their id in dotted form."""
    sr = C.laws(s, d).select(normalize_sr(F.col("sr_number")).alias("sr")).where("sr is not null").select(F.split_part("sr", F.lit("."), F.lit(1)).alias("chapter_id")).distinct()
    names = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    first = F.substring("chapter_id", 1, 1)
    return sr.select(first.alias("domain_id"), F.coalesce(F.try_element_at(names, first), F.lit("unknown")).alias("domain_name"), "chapter_id", F.array_join(F.filter(F.split("chapter_id", ""), lambda x: x != ""), ".").alias("dotted"))


# ---- reports ----


@query(f"""with {C.LAWS}, {C.ARTICLES}, {C.VERSIONS}, {C.LEVELS}, {C.REFS}, h as (select law_uri, {C._sql_title('title_de')} is not null as de, {C._sql_title('title_fr')} is not null as fr, {C._sql_title('title_it')} is not null as it, law_uri in (select law_uri from a where law_uri is not null) as art,
  law_uri in (select law_uri from v) as ver, law_uri in (select law_uri from t where law_uri is not null) as tax from l), x as (select count(*) as n, 100.0 * avg(art::int) as content, (sum(de::int) + sum(fr::int) + sum(it::int)) * 100.0 / (3 * count(*)) as language, (sum(art::int) + sum(ver::int) + sum(tax::int)) * 100.0 / (3 * count(*)) as structure from h),
  y as (select least(count(*) / 10.0, 100.0) as refs from r) select n as n_laws, round(content, 6)::double as content_score, round(language, 6)::double as language_score, round(structure, 6)::double as structure_score, round(refs, 6)::double as reference_score, round((content + language + structure + refs) / 4, 6)::double as overall from x, y""")
def coverage_scores(s, d):
    """Four coverage scores and their mean."""
    mark = lambda df, name: df.select("law_uri").where("law_uri is not null").distinct().withColumn(name, F.lit(1))
    j = C.laws(s, d).join(mark(C.articles(s, d), "art"), "law_uri", "left").join(mark(C.versions(s, d), "ver"), "law_uri", "left").join(mark(C.levels(s, d), "tax"), "law_uri", "left")
    n = F.count(F.lit(1))
    titles = sum((F.count(C._real_title(c)) for c in ("title_de", "title_fr", "title_it")), F.lit(0))
    x = j.agg(n.alias("n"), (100.0 * F.count("art") / n).alias("content"), (titles * 100.0 / (3 * n)).alias("language"), ((F.count("art") + F.count("ver") + F.count("tax")) * 100.0 / (3 * n)).alias("structure"))
    y = table(s, d, "html_references").agg(F.least(F.count_distinct("ref_id") / 10.0, F.lit(100.0)).alias("refs"))
    mean = (F.col("content") + F.col("language") + F.col("structure") + F.col("refs")) / 4
    return x.join(y).select(F.col("n").alias("n_laws"), *[F.round(c, 6).alias(a) for c, a in (("content", "content_score"), ("language", "language_score"), ("structure", "structure_score"), ("refs", "reference_score"))], F.round(mean, 6).alias("overall"))


@query("select coalesce(x.lang, 'none') as lang, count(*) as n_documents, count(e.embedding) as with_embedding from documents x left join embeddings e on x.doc_id = e.vec_id group by 1")
def embeddings_by_language(s, d):
    e = table(s, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    return table(s, d, "documents").select("doc_id", "lang").join(e, "doc_id", "left").groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n_documents"), F.count("has").alias("with_embedding"))


@query("""select event_type as stage, case when value is null then 'unknown' when value >= 50 then 'critical' when value >= 20 then 'error' else 'warning' end as severity, count(*) as n_events, count(distinct user_id) as n_users, max(ts) as latest from events group by 1, 2""")
def event_report(s, d):
    """Totals by stage and severity, with the latest."""
    severity = F.when(F.col("value").isNull(), "unknown").when(F.col("value") >= 50, "critical").when(F.col("value") >= 20, "error").otherwise("warning")
    return table(s, d, "events").groupBy(F.col("event_type").alias("stage"), severity.alias("severity")).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.max("ts").alias("latest"))


@query(f"""with x as (select {_uri('law_uri')} as law_uri, number, lang, title, loaded_at from article_nodes where title is not null) select law_uri, number, {', '.join(f"arg_min(title, (loaded_at, title)) filter (lang = '{c}') as first_{c}" for c in ('de', 'fr', 'it'))} from x where law_uri is not null group by 1, 2""")
def article_titles_first(s, d):
    """Titles of an article by language, the first delivered of each."""
    a = table(s, d, "article_nodes").select(canonical_uri(F.col("law_uri")).alias("law_uri"), "number", "lang", "title", "loaded_at").where("law_uri is not null and title is not null")
    first = lambda c: F.min(F.when(F.col("lang") == c, F.struct("loaded_at", "title")))["title"].alias(f"first_{c}")
    return a.groupBy("law_uri", "number").agg(*[first(c) for c in ("de", "fr", "it")])


@query(f"""with {C.VERSIONS} select law_uri, uri, start, row_number() over (partition by law_uri order by start desc, uri desc)::int as place from v qualify place <= 3""")
def newest_versions(s, d):
    """The three newest versions of each law; each task cuts its groups before the shuffle."""
    order = Window.partitionBy("law_uri").orderBy(F.desc("start"), F.desc("uri"))
    return C.versions(s, d).select("law_uri", "uri", "start", F.row_number().over(order).alias("place")).where("place <= 3")


_INTENTS = {
    "OBLIGATION": "muss|müssen|verpflichtet|pflicht|doit|obligation|must|shall|required", "PERMISSION": "darf|dürfen|kann|können|peut|peuvent|may|can|allowed", "PROHIBITION": "verboten|untersagt|interdit|vietato|prohibited", "CONDITION": "wenn|falls|sofern|lorsque|si |if ",
    "EXCEPTION": "ausser|ausgenommen|sauf|hormis|salvo|except|unless", "TIMELINE": "frist|tage|monat|jahr|délai|jours|mois|days|months|years", "RIGHTS": "anspruch|recht auf|droit à|diritto|right to|entitled",
}


@query(f"""with {C.ARTICLES}, w as (select uri, lower(content_full) as t from a where content_full is not null), k as (select uri, list_filter([{', '.join(f"case when regexp_matches(t, {X._q(p)}) then '{n}' end" for n, p in _INTENTS.items())}], lambda x: x is not null) as l from w)
select uri, array_to_string(l, ',') as intents, l[1] as first_intent, len(l)::int as n_intents from k""")
def rule_intent_labels(s, d):
    """All seven intents of each article's wording, the first by priority."""
    t = F.lower("content_full")
    l = F.array_compact(F.array(*[F.when(t.rlike(p), n) for n, p in _INTENTS.items()]))
    return C.articles(s, d).where("content_full is not null").select("uri", l.alias("l")).select("uri", F.array_join("l", ",").alias("intents"), F.get("l", F.lit(0)).alias("first_intent"), F.size("l").alias("n_intents"))


@query(f"""with {C._PATHS}, f as (select uri, path, len(string_split(path, '/')) - 1 as lv, split_part(path, '/', 2) as seg from pn), q as (select distinct 'sr_' || replace(substr(n, 4), '.', '_') as seg, n as name from (select {_designation('target_law')} as n from html_references) where n like 'sr:%'),
  s as (select q.name, f.uri, round(least(1.0, 0.5 + case when lv = 3 then 0.3 when abs(lv - 3) = 1 then 0.1 else 0 end + 0.2 + case when contains(path, '/art_') then 0.1 else 0 end + (8 - lv) * 0.02), 6)::double as score from q join f using (seg))
select * from s qualify row_number() over (partition by name order by score desc, uri) <= 10""")
def path_search(s, d):
    """For every number that is cited, the ten best nodes of its path, scored by level, law and article."""
    f = C.path_nodes(s, d).withColumns({"lv": F.size(F.split("path", "/")) - 1, "seg": F.split_part("path", F.lit("/"), F.lit(2))})
    q = table(s, d, "html_references").select(law_designation(F.col("target_law")).alias("name")).where("name like 'sr:%'").distinct().withColumn("seg", F.concat(F.lit("sr_"), F.replace(F.expr("substr(name, 4)"), F.lit("."), F.lit("_"))))
    score = 0.5 + F.when(F.col("lv") == 3, 0.3).when(F.abs(F.col("lv") - 3) == 1, 0.1).otherwise(0.0) + 0.2 + F.when(F.col("path").contains("/art_"), 0.1).otherwise(0.0) + (8 - F.col("lv")) * 0.02
    return R.top_per_group(f.join(q, "seg").select("name", "uri", F.round(F.least(F.lit(1.0), score), 6).alias("score")), ["name"], [F.desc("score"), F.asc("uri")], 10)


@query(f"with {C._BM25} select b.doc_id, coalesce(x.doc_kind, 'none') as doc_kind, round(bm25 / max(bm25) over (partition by x.doc_kind), 6) as bm25_norm from b join documents x using (doc_id)")
def bm25_by_kind(s, d):
    """Keyword scores normalized by the best of each kind of document."""
    b = R.bm25(C.dealt(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", C.WORDS).join(table(s, d, "documents").select("doc_id", "doc_kind"), "doc_id")
    b = b.withColumn("doc_kind", F.coalesce("doc_kind", F.lit("none")))
    return b.join(b.groupBy("doc_kind").agg(F.max("bm25").alias("m")), "doc_kind").select("doc_id", "doc_kind", F.round(F.col("bm25") / F.col("m"), 6).alias("bm25_norm"))


@query(f"""with {C.LAWS}, {C.LAWNAMES}, {C.REFS}, k as (select r.ref_id, r.extracted_at, names.target, l.law_uri, regexp_extract(l.in_force_status, '(\\d)/?\\s*$', 1) as st, l.deleted_at from r left join names on {_designation('r.target_law')} = names.name left join l on names.target = l.law_uri where {_designation('r.target_law')} is not null)
select unnest(list_filter([case when target is null then 'unknown law' end, case when st = '3' then 'repealed' end, case when st = '2' then 'not yet in force' end, case when law_uri is not null and coalesce(st, '') = '' then 'status not told' end, case when deleted_at <= extracted_at then 'deleted' end], lambda x: x is not null)) as issue, count(*) as n_refs from k group by 1""")
def reference_issues(s, d):
    """What speaks against the laws that references name, counted."""
    r = C.references(s, d).select("ref_id", "extracted_at", law_designation(F.col("target_law")).alias("name")).where("name is not null")
    l = C.laws(s, d).select(F.col("law_uri").alias("target"), F.coalesce(status_digit(F.col("in_force_status")), F.lit("")).alias("st"), "deleted_at", F.lit(1).alias("known"))
    k = r.join(C.law_names(s, d), "name", "left").join(l, "target", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("target").isNull(), "unknown law"), F.when(F.col("st") == "3", "repealed"), F.when(F.col("st") == "2", "not yet in force"),
        F.when(F.col("known").isNotNull() & F.coalesce(F.col("st") == "", F.lit(False)), "status not told"), F.when(F.col("deleted_at") <= F.col("extracted_at"), "deleted"),
    ))
    return k.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n_refs"))


@query(f"""with {C.REFS}, p as (select ref_id, {_designation('target_law')} as n, raw_text from r) select ref_id, case when n like 'https:%' then 'uri' when n like 'sr:%' then 'number' when n like 'abbr:%' then 'abbreviation' when regexp_matches(raw_text, '(?i)art\\.?\\s*\\d') then 'text' else 'none' end as cited_by,
  coalesce(n, nullif(regexp_extract(raw_text, '(?i)art\\.?\\s*(\\d+[a-z]*)', 1), '')) as citation from p""")
def citation_sources(s, d):
    """What tells each citation: URI, number, abbreviation or, failing these, the text."""
    n = F.col("n")
    by = F.when(n.startswith("https:"), "uri").when(n.startswith("sr:"), "number").when(n.startswith("abbr:"), "abbreviation").when(F.col("raw_text").rlike(r"(?i)art\.?\s*\d"), "text").otherwise("none")
    text = F.nullif(F.regexp_extract("raw_text", r"(?i)art\.?\s*(\d+[a-z]*)", 1), F.lit(""))
    return C.references(s, d).select("ref_id", law_designation(F.col("target_law")).alias("n"), "raw_text").select("ref_id", by.alias("cited_by"), F.coalesce("n", text).alias("citation"))


# ---- sessions as trees ----


@query("""with e as (select user_id, ts, event_id, event_type, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
  g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from e)
select event_id, lag(event_id) over w as parent_id, (row_number() over w - 1)::int as depth, round(greatest(0.1, 1 - 0.1 * (row_number() over w - 1)), 6)::double as relevance, first_value(event_id) over w as root_id from g window w as (partition by user_id, sid order by ts, event_id)""")
def session_turns(s, d):
    """Each turn of a session with the one before it, its depth and its relevance, which decays with depth; windows are bounded by one user's events."""
    user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(user) >= F.expr("interval 30 minutes")
    e = table(s, d, "events").select("user_id", "ts", "event_id", F.when(gap.isNull() | gap, 1).otherwise(0).alias("new")).withColumn("sid", F.sum("new").over(user))
    turn = Window.partitionBy("user_id", "sid").orderBy("ts", "event_id")
    depth = F.row_number().over(turn) - 1
    return e.select("event_id", F.lag("event_id").over(turn).alias("parent_id"), depth.alias("depth"), F.round(F.greatest(F.lit(0.1), 1 - 0.1 * depth), 6).alias("relevance"), F.first("event_id").over(turn).alias("root_id"))


@query("""with e as (select user_id, ts, event_id, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minute then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
  g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from e), n as (select user_id, sid, min(ts) as started, max(ts) as ended, count(*) as n_turns from g group by 1, 2), m as (select max(ts) as now from events)
select user_id, started, ended, n_turns, ended + interval 30 minute < now as expired, n_turns > 10 as over_limit from n, m""")
def session_states(s, d):
    """Sessions with their end, and whether they have expired or run over the limit of turns."""
    e = table(s, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n_turns"))
    now = table(s, d, "events").agg(F.max("ts").alias("now"))
    return e.join(now).select("user_id", "started", "ended", "n_turns", (F.col("ended") + F.expr("interval 30 minutes") < F.col("now")).alias("expired"), (F.col("n_turns") > 10).alias("over_limit"))


@query(f"""with {C.LAWREFS}, {C.VERSIONS}, nw as (select law_uri, max(start) as newest from v group by 1), f as (select l.law_uri, coalesce({C.SR_SQL}, '') as sr, newest, regexp_extract(in_force_status, '(\\d)/?\\s*$', 1) as st from l left join nw using (law_uri)),
  x as (select lr.dst as target, f.law_uri, case when sr like '101%' then 1 when sr like '210%' or sr like '220%' then 2 when sr like '235%' then 3 else 4 end as rank, newest, length(sr) as n, st from lr join f on lr.src = f.law_uri),
  k as (select target, count(*) as c, min(rank) as r0, max(rank) as r1, min(newest) as n0, max(newest) as n1, min(n) as l0, max(n) as l1, count(*) filter (st = '3') as gone from x group by 1)
select target, unnest(list_filter([case when c > 1 and r0 < r1 then 'superior' end, case when c > 1 and n0 < n1 then 'posterior' end, case when c > 1 and l0 < l1 then 'specialis' end, case when gone > 0 then 'validity' end], lambda y: y is not null)) as rule from k""")
def precedence_rules(s, d):
    """Which rules of precedence settle something among the laws that refer to one law."""
    newest = C.versions(s, d).groupBy("law_uri").agg(F.max("start").alias("newest"))
    f = C.laws(s, d).select("law_uri", F.coalesce(normalize_sr(F.col("sr_number")), F.lit("")).alias("sr"), status_digit(F.col("in_force_status")).alias("st")).join(newest, "law_uri", "left")
    rank = F.when(F.col("sr").like("101%"), 1).when(F.col("sr").like("210%") | F.col("sr").like("220%"), 2).when(F.col("sr").like("235%"), 3).otherwise(4)
    f = f.select("law_uri", rank.alias("rank"), "newest", F.length("sr").alias("n"), "st")
    x = C.law_references(s, d).select(F.col("dst").alias("target"), F.col("src").alias("law_uri")).join(f, "law_uri")
    several = F.count(F.lit(1)) > 1
    rules = F.array_compact(F.array(*[F.when(several & (F.min(c) < F.max(c)), n) for c, n in (("rank", "superior"), ("newest", "posterior"), ("n", "specialis"))], F.when(F.count_if(F.col("st") == "3") > 0, "validity")))
    return x.groupBy("target").agg(rules.alias("rules")).select("target", F.explode("rules").alias("rule"))


@query(f"""with {C.LAWS}, {C.VARIANTS}, {C.ARTICLES}, ga as (select law_uri, count(*) as n_variants, min(uri) as first_variant from g where law_uri is not null group by 1), aa as (select law_uri, count(*) as n_articles from a where law_uri is not null group by 1)
select l.law_uri, coalesce(n_variants, 0) as n_variants, first_variant, coalesce(n_articles, 0) as n_articles from l left join ga using (law_uri) left join aa using (law_uri)""")
def law_context(s, d):
    """Each law with what stands around it: variants and articles, to be joined to any list of hits."""
    g = C.variants(s, d).where("law_uri is not null").groupBy("law_uri").agg(F.count(F.lit(1)).alias("n_variants"), F.min("uri").alias("first_variant"))
    a = C.articles(s, d).where("law_uri is not null").groupBy("law_uri").agg(F.count(F.lit(1)).alias("n_articles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return C.laws(s, d).select("law_uri").join(g, "law_uri", "left").join(a, "law_uri", "left").select("law_uri", zero("n_variants"), "first_variant", zero("n_articles"))
