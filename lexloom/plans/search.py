"""Search queries: titles and contents of all nodes, filters, classification, keyword scores and merged methods for every stated query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.citations import law_number_of_uri, law_type
from lexloom.functions.sr import normalize_sr
from lexloom.functions.uris import canonical_uri, law_designation
from lexloom.operators import retrieval as R
from lexloom.plans import catalogue as C
from lexloom.plans import texts as T
from lexloom.plans.problems import _designation, _uri
from lexloom.session import dealt, materialize, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- nodes of every label ----

_NODES = f"""{C.LAWS}, {C.VERSIONS}, {C.VARIANTS}, {C.ARTICLES}, {C.LEVELS},
  nodes as (select 'Law' as label, law_uri as uri, coalesce(title_de, title_fr, title_it, 'SR ' || sr_number, law_uri) as display_title, coalesce(title_de, title_fr, title_it) as display_content from l
    union all select 'Version', uri, 'Version ' || strftime(start, '%Y-%m-%d'), null from v union all select 'LawLanguageVariant', uri, coalesce(title, uri), title from g
    union all select 'Article', uri, concat('Art. ', coalesce(number, '?'), coalesce(': ' || left(coalesce(content_full, title), 80), '')), content_full from a
    union all select 'TaxonomyLevel', uri, coalesce(title_de, title_fr, title_it, level_name, uri), level_name from t)"""


def _nodes(s, d) -> DataFrame:
    take = lambda df, label, uri, title, content: df.select(F.lit(label).alias("label"), F.col(uri).alias("uri"), title.alias("display_title"), content.alias("display_content"))
    names = F.coalesce("title_de", "title_fr", "title_it")
    none = F.lit(None).cast("string")
    article = F.concat(F.lit("Art. "), F.coalesce("number", F.lit("?")), F.coalesce(F.concat(F.lit(": "), F.substring(F.coalesce("content_full", "title"), 1, 80)), F.lit("")))
    return (
        take(C.laws(s, d), "Law", "law_uri", F.coalesce(names, F.concat(F.lit("SR "), "sr_number"), "law_uri"), names)
        .unionByName(take(C.versions(s, d), "Version", "uri", F.concat(F.lit("Version "), F.date_format("start", "yyyy-MM-dd")), none))
        .unionByName(take(C.variants(s, d), "LawLanguageVariant", "uri", F.coalesce("title", "uri"), F.col("title")))
        .unionByName(take(C.articles(s, d), "Article", "uri", article, F.col("content_full")))
        .unionByName(take(C.levels(s, d), "TaxonomyLevel", "uri", F.coalesce(names, "level_name", "uri"), F.col("level_name")))
    )


@query(f"with {_NODES} select * from nodes")
def node_titles(s, d):
    """Display title and content of every node by its label."""
    return _nodes(s, d)


@query(f"with {C.LAWS}, {C.LAWNAMES}, {C.REFS}, q as (select distinct {_designation('target_law')} as name from r) select q.name, target as law_uri from q join names using (name) where q.name is not null")
def node_lookup(s, d):
    """Each name that a reference uses, looked up by URI, number or abbreviation; the first law of a name."""
    q = table(s, d, "html_references").select(law_designation(F.col("target_law")).alias("name")).where("name is not null").distinct()
    return q.join(C.law_names(s, d), "name").select("name", F.col("target").alias("law_uri"))


@query(f"with {C.REFS}, w as (select distinct ref_id, unnest(regexp_extract_all(context_text, '\\b[A-Z][A-Za-z]{{1,5}}\\b')) as word from r where context_text is not null), c as (select abbreviation, min(sr_number) as sr from code_articles group by 1) select ref_id, abbreviation, sr from w join c on w.word = c.abbreviation")
def abbreviation_hits(s, d):
    """Laws whose abbreviation stands in a text as a word of its own, with its case."""
    w = C.references(s, d).where("context_text is not null").select("ref_id", F.explode(F.array_distinct(F.regexp_extract_all("context_text", F.lit(r"\b[A-Z][A-Za-z]{1,5}\b"), F.lit(0)))).alias("abbreviation"))
    c = table(s, d, "code_articles").groupBy("abbreviation").agg(F.min("sr_number").alias("sr"))
    return w.join(c, "abbreviation").select("ref_id", "abbreviation", "sr")


@query(f"with {C.ARTICLES}, {T._KEYS}, c as (select distinct uri, ast_path, unnest(regexp_extract_all(lower(content_full), '[a-zà-ÿ]+')) as word from a where ast_path is not null and content_full is not null), w as (select distinct word from k) select uri, ast_path, count(*) as n_words, 0.5::double as score from c join w using (word) group by 1, 2")
def path_text_hits(s, d):
    """Articles with a path whose content holds keywords of the test questions, at the score of text hits; the questions are a stated set, their words are sent to the articles."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("content_full"), F.lit("[a-zà-ÿ]+"), F.lit(0)))
    c = C.articles(s, d).where("ast_path is not null and content_full is not null").select("uri", "ast_path", F.explode(words).alias("word"))
    asked = T.question_keywords(s, d).select("word").distinct()
    return c.join(asked, "word").groupBy("uri", "ast_path").agg(F.count(F.lit(1)).alias("n_words")).withColumn("score", F.lit(0.5))


@query(f"with {C.ARTICLES} select lang, count(*) as n_articles, sum(length(content_full))::bigint as n_chars from a where lang is not null and content_full is not null and trim(content_full) <> '' group by 1")
def articles_with_content(s, d):
    """The filter on language and content: what it lets through."""
    return C.articles(s, d).where("lang is not null and content_full is not null and trim(content_full) <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n_articles"), F.sum(F.length("content_full").cast("long")).alias("n_chars"))


@query(f"""with {C.REFS}, h as (select ref_id, nullif(regexp_extract(raw_text, '(\\d{{3}}(?:\\.\\d+)*)', 1), '') as sr, nullif(regexp_extract(raw_text, '(?i)art\\.?\\s*(\\d+[a-z]*)', 1), '') as article from r where raw_text is not null)
select ref_id, unnest(list_filter([case when sr is not null then '/sr_' || replace(sr, '.', '_') || '*' end, case when sr is not null and article is not null then '/sr_' || replace(sr, '.', '_') || '*/art_' || article end, case when sr is null and article is not null then '*/art_' || article end, case when sr is null and article is null then '*' end], lambda x: x is not null)) as pattern from h""")
def path_patterns(s, d):
    """Patterns of paths built from the hints of each reference's text."""
    got = lambda p: F.nullif(F.regexp_extract("raw_text", p, 1), F.lit(""))
    h = C.references(s, d).where("raw_text is not null").select("ref_id", got(r"(\d{3}(?:\.\d+)*)").alias("sr"), got(r"(?i)art\.?\s*(\d+[a-z]*)").alias("article"))
    base, art = F.concat(F.lit("/sr_"), F.replace("sr", F.lit("."), F.lit("_")), F.lit("*")), F.concat(F.lit("/art_"), "article")
    none = F.col("sr").isNull()
    return h.select("ref_id", F.explode(F.array_compact(F.array(base, F.concat(base, art), F.when(none, F.concat(F.lit("*"), art)), F.when(none & F.col("article").isNull(), F.lit("*"))))).alias("pattern"))


@query(f"with {C.LAWS} select law_uri, case when contains(law_uri, '/cc/') then 'classified compilation' when contains(law_uri, '/oc/') then 'official compilation' when contains(law_uri, '/fga/') then 'federal gazette' when contains(law_uri, '/treaty/') then 'treaty' else 'other' end as law_type from l")
def law_types(s, d):
    return C.laws(s, d).select("law_uri", law_type(F.col("law_uri")).alias("law_type"))


@query(f"""with u as (select distinct {_uri('target_law')} as uri from html_references where {_uri('target_law')} like 'https:%'), p as (select uri, regexp_extract(uri, '/eli/cc/(.+)$', 1) as path from u)
select uri, case when path = '' then null when regexp_matches(path, '^[IVXLC]+/') then concat_ws(' ', 'SR', regexp_extract(path, '^([IVXLC]+)/', 1), regexp_extract(path, '^[IVXLC]+/([^_/]+)', 1)) when regexp_matches(path, '__[^/]+') then 'Special ' || regexp_extract(path, '__([^/]+)', 1)
  when regexp_matches(path, '^\\d+/') then 'SR ' || regexp_extract(path, '^(\\d+)/', 1) || '.' || regexp_extract(path, '^\\d+/([^/]+)', 1) else 'SR ' || path end as number from p""")
def uri_numbers(s, d):
    """The number that each cited URI tells."""
    return table(s, d, "html_references").select(canonical_uri(F.col("target_law")).alias("uri")).where("uri like 'https:%'").distinct().select("uri", law_number_of_uri(F.col("uri")).alias("number"))


@query(f"""with {C.LAWS}, {C.VARIANTS}, vs as (select g.law_uri, min(x.sr_number) as sr from g join (select {_uri('uri')} as uri, sr_number from law_language_variants where sr_number is not null) x using (uri) where g.law_uri is not null group by 1),
  p as (select law_uri, regexp_extract(ast_path, '^/sr_([0-9_]+)', 1) as pp from l)
select l.law_uri, coalesce({C.SR_SQL.replace('sr_number', 'l.sr_number')}, {C.SR_SQL.replace('sr_number', 'vs.sr')}, nullif(replace(pp, '_', '.'), '')) as sr, case when {C.SR_SQL.replace('sr_number', 'l.sr_number')} is not null then 'law' when {C.SR_SQL.replace('sr_number', 'vs.sr')} is not null then 'variant' when pp <> '' then 'path' else 'none' end as found_in
from l left join vs using (law_uri) join p using (law_uri)""")
def resolved_numbers(s, d):
    """The number of each law from the first source that tells one: the law, its variants, its path."""
    raw = table(s, d, "law_language_variants").select(canonical_uri(F.col("uri")).alias("uri"), "sr_number").where("sr_number is not null and uri is not null")
    vs = C.variants(s, d).where("law_uri is not null").select("uri", "law_uri").join(raw, "uri").groupBy("law_uri").agg(F.min("sr_number").alias("v"))
    l = C.laws(s, d).select("law_uri", normalize_sr(F.col("sr_number")).alias("a"), F.nullif(F.regexp_replace(F.regexp_extract("ast_path", "^/sr_([0-9_]+)", 1), "_", "."), F.lit("")).alias("c"))
    b = normalize_sr(F.col("v"))
    return l.join(vs, "law_uri", "left").select("law_uri", F.coalesce("a", b, "c").alias("sr"), F.when(F.col("a").isNotNull(), "law").when(b.isNotNull(), "variant").when(F.col("c").isNotNull(), "path").otherwise("none").alias("found_in"))


# ---- classification ----

_SRL = f"n as (select law_uri, {C.SR_SQL} as sr from l), x as (select law_uri, sr, split_part(sr, '.', 1) as a, split_part(sr, '.', 2) as b from n where sr is not null)"


@query(f"""with {C.LAWS}, {_SRL} select law_uri as src, 'sr://domain/' || a[1] || case when length(a) >= 2 then '/book/' || a[1:2] else '' end || case when length(a) >= 3 then '/chapter/' || a else '' end || case when length(a) >= 3 and b <> '' then '/section/' || b else '' end as dst, 'CLASSIFIED_BY' as type from x""")
def classified_by(s, d):
    """Edges from each law to the most specific level of its number."""
    from lexloom.functions.sr import sr_levels

    x = C.laws(s, d).select("law_uri", sr_levels(normalize_sr(F.col("sr_number"))).alias("ls")).where("ls is not null and size(ls) > 0")
    return x.select(F.col("law_uri").alias("src"), F.element_at("ls", -1)["level_uri"].alias("dst"), F.lit("CLASSIFIED_BY").alias("type"))


@query(f"""with {C.LAWS}, {C.LEVELS}, {_SRL}, sec as (select uri, law_uri, lower(level_type) as kind from t where law_uri is not null) select x.law_uri as src, sec.uri as dst, 'BELONGS_TO' as type from x join sec using (law_uri) where kind = 'domain' and sec.uri not in (select uri from t where parent_uri is not null)""")
def law_roots(s, d):
    """BELONGS_TO edges between laws with a number and the top levels that name them."""
    roots = C.levels(s, d).where("lower(level_type) = 'domain' and parent_uri is null and law_uri is not null").select("law_uri", F.col("uri").alias("dst"))
    l = C.laws(s, d).where(normalize_sr(F.col("sr_number")).isNotNull()).select("law_uri")
    return l.join(roots, "law_uri").select(F.col("law_uri").alias("src"), "dst", F.lit("BELONGS_TO").alias("type"))


@query(f"""with {C.LAWS}, {_SRL}, sec as (select distinct a || '.' || b as number, 'sr://domain/' || a[1] || '/book/' || a[1:2] || '/chapter/' || a || '/section/' || b as uri from x where length(a) >= 3 and b <> '') select x.law_uri as src, sec.uri as dst, 'BELONGS_TO' as type from x join sec on x.sr = sec.number""")
def belongs_to_section(s, d):
    """Edges from each law to the section of its number, where the number is the section's own."""
    from lexloom.functions.sr import sr_levels

    x = C.laws(s, d).select("law_uri", normalize_sr(F.col("sr_number")).alias("sr")).where("sr is not null")
    sec = x.select("sr", F.explode(sr_levels(F.col("sr"))).alias("v")).where("v.level = 'section'").select(F.concat_ws(".", F.split_part("sr", F.lit("."), F.lit(1)), F.split_part("sr", F.lit("."), F.lit(2))).alias("sr"), F.col("v.level_uri").alias("dst")).distinct()
    return x.join(sec, "sr").select(F.col("law_uri").alias("src"), "dst", F.lit("BELONGS_TO").alias("type"))


@query(f"""with {C.LEVELS}, k as (select uri, case when lower(coalesce(title_de, '') || ' ' || coalesce(level_name, '')) similar to '.*(kapitel|chapitre|capitolo).*' then 'chapter' when lower(coalesce(title_de, '') || ' ' || coalesce(level_name, '')) similar to '.*(abschnitt|sezione).*' then 'section' else lower(level_type) end as kind,
  nullif(regexp_extract(number, '(\\d+)', 1), '') as n, title_de from t) select uri, kind, try_cast(n as int) as heading_number, title_de as heading from k""")
def heading_parts(s, d):
    """Kind, number and title of each heading, by its words before its declared kind."""
    words = F.lower(F.concat_ws(" ", F.coalesce("title_de", F.lit("")), F.coalesce("level_name", F.lit(""))))
    kind = F.when(words.rlike("kapitel|chapitre|capitolo"), "chapter").when(words.rlike("abschnitt|sezione"), "section").otherwise(F.lower("level_type"))
    return C.levels(s, d).select("uri", kind.alias("kind"), F.nullif(F.regexp_extract("number", r"(\d+)", 1), F.lit("")).try_cast("int").alias("heading_number"), F.col("title_de").alias("heading"))


@query(f"""with {C.LEVELS}, {C.ARTICLES}, p as (select {_uri('uri')} as uri, {_uri('parent_id')} as parent, loaded_at from article_nodes), pl as (select uri, parent, row_number() over (partition by uri order by loaded_at desc, parent desc nulls last) as rn from p where uri is not null)
select parent as uri, count(*) as n_articles, min(pl.uri) as first_article, max(pl.uri) as last_article from pl join t on pl.parent = t.uri where rn = 1 group by 1""")
def level_articles(s, d):
    """Articles below each level, with the first and last."""
    from lexloom.operators.dedup import latest_delivery

    raw = table(s, d, "article_nodes").select(canonical_uri(F.col("uri")).alias("article"), canonical_uri(F.col("parent_id")).alias("uri"), "loaded_at").where("article is not null")
    last = latest_delivery(raw, ["article"], "loaded_at", ["uri"])
    return last.join(C.levels(s, d).select("uri"), "uri").groupBy("uri").agg(F.count(F.lit(1)).alias("n_articles"), F.min("article").alias("first_article"), F.max("article").alias("last_article"))


@query(f"""with {C.LAWS}, {C.ARTICLES}, c as (select law_uri, count(*) as n from a where law_uri is not null group by 1) select round(avg(n), 6) as avg_articles, min(n) as min_articles, max(n) as max_articles, count(*) as n_laws
from c join l using (law_uri) where in_force and not (date_no_longer_in_force is not null and date_no_longer_in_force <> '')""")
def articles_per_law_in_force(s, d):
    l = C.laws(s, d).where("in_force and coalesce(date_no_longer_in_force, '') = ''").select("law_uri")
    n = C.G.count_by(C.articles(s, d).where("law_uri is not null"), "law_uri").join(l, "law_uri")
    return n.agg(F.round(F.avg("n"), 6).alias("avg_articles"), F.min("n").alias("min_articles"), F.max("n").alias("max_articles"), F.count(F.lit(1)).alias("n_laws"))


@query(f"""with {C.ARTICLES}, {C.LAWS}, x as (select a.uri, l.law_uri is not null as known, a.ast_path is not null and a.ast_path <> '' as pathed from a left join l on a.law_uri = l.law_uri) select count(*) as n_articles, round(100.0 * avg(known::int), 2)::double as pct_law, round(100.0 * avg(pathed::int), 2)::double as pct_path from x""")
def place_percentages(s, d):
    a = C.articles(s, d).select("law_uri", "ast_path").join(C.laws(s, d).select("law_uri", F.lit(1).alias("known")), "law_uri", "left")
    n = F.count(F.lit(1))
    return a.agg(n.alias("n_articles"), F.round(100.0 * F.count("known") / n, 2).alias("pct_law"), F.round(100.0 * F.count(F.nullif("ast_path", F.lit(""))) / n, 2).alias("pct_path"))


@query(f"""with {C.ARTICLES}, {C.LAWS}, b as (select a.uri, '/sr_' || replace({C.SR_SQL.replace('sr_number', 'l.sr_number')}, '.', '_') || '/' || a.lang || '/art_' || lower(trim(a.number)) as fixed_path from a join l using (law_uri) where a.number is not null and a.lang is not null and coalesce(a.ast_path, '') = '') select * from b where fixed_path is not null""")
def repaired_paths(s, d):
    """Paths for the articles that lack one, from their law's number, language and number."""
    law = C.laws(s, d).select("law_uri", F.regexp_replace(normalize_sr(F.col("sr_number")), r"\.", "_").alias("sr")).where("sr is not null")
    a = C.articles(s, d).where("number is not null and lang is not null and coalesce(ast_path, '') = ''").join(law, "law_uri")
    return a.select("uri", F.concat(F.lit("/sr_"), "sr", F.lit("/"), "lang", F.lit("/art_"), F.lower(F.trim("number"))).alias("fixed_path"))


@query(f"with {C.LAWREFS} select src as law_uri, count(*) as n_laws, min(dst) as first_law, max(dst) as last_law from lr group by 1")
def referenced_laws(s, d):
    """Laws that each law refers to: how many, the first and the last."""
    return C.law_references(s, d).groupBy(F.col("src").alias("law_uri")).agg(F.count(F.lit(1)).alias("n_laws"), F.min("dst").alias("first_law"), F.max("dst").alias("last_law"))


@query(f"""with {C.VERSIONS} select a.law_uri, a.uri, count(b.uri) as n_overlapping, min(b.start) as first_start, max(b.start) as last_start from v a join v b on a.law_uri = b.law_uri and a.start < b.start and (a."end" is null or a."end" > b.start) group by 1, 2""")
def overlap_ranges(s, d):
    """For each version how many later ones begin while it is valid, and from when to when: ranges over the distinct starts of a law, not pairs."""
    from pyspark.sql import Window

    v = C.versions(s, d)
    starts = v.groupBy("law_uri", "start").agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("law_uri").orderBy("start")
    upto = starts.select("law_uri", F.col("start").alias("at"), "c", F.sum("c").over(order).alias("upto"), F.lead("start").over(order).alias("next_start"))
    ends = v.select("law_uri", "uri", F.col("start").alias("at"), "end")
    # versions and starts in one order: what has begun before the end, less what had begun with the version itself
    end_at = F.coalesce("end", F.expr("timestamp_ntz'9999-12-31 00:00:00'"))
    events = upto.select("law_uri", "at", "upto", F.lit(None).cast("string").alias("uri")).unionByName(ends.select("law_uri", end_at.alias("at"), F.lit(None).cast("long").alias("upto"), "uri"))
    before = Window.partitionBy("law_uri").orderBy(F.col("at"), F.col("uri").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    known = events.select("law_uri", "uri", F.last("upto", True).over(before).alias("begun"), F.last(F.when(F.col("upto").isNotNull(), F.col("at")), True).over(before).alias("last_start")).where("uri is not null")
    mine = ends.join(upto.select("law_uri", "at", "upto", "next_start"), ["law_uri", "at"]).join(known, ["law_uri", "uri"])
    return mine.where(F.col("begun") > F.col("upto")).select("law_uri", "uri", (F.col("begun") - F.col("upto")).alias("n_overlapping"), F.col("next_start").alias("first_start"), "last_start")


# ---- keyword and hybrid scores of every stated query: the documents and vectors whose id is divisible by 100 ----

TOP, HYBRID_TOP = 20, 50


def question_words(s, d) -> DataFrame:
    """(query_id, words): the first keywords of each document whose id is divisible by 100."""
    return table(s, d, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), T.keywords(F.col("text")).alias("words"))


@query()
def bm25_topk_all(s, d):
    """The best documents for the keywords of each stated query; see :func:`retrieval.bm25_blocks`."""
    b = R.bm25_blocks(dealt(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", question_words(s, d), TOP)
    return R.top_per_group(b, ["query_id"], [F.desc("bm25"), F.asc("doc_id")], TOP).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@query()
def hybrid_questions(s, d):
    """Vector and keyword scores of each stated query, its own vector and its own text's keywords, merged by the four-way weights into the best of both."""
    words = R.bm25_blocks(dealt(table(s, d, "documents").select("doc_id", "text")), "doc_id", "text", question_words(s, d), HYBRID_TOP)
    best = words.groupBy("query_id").agg(F.max("bm25").alias("m"))
    k = words.join(best, "query_id").select("query_id", F.col("doc_id").alias("id"), F.lit("hybrid").alias("method"), (F.col("bm25") / F.col("m")).alias("score"))
    v = C._all_cosines(s, d, HYBRID_TOP).select("query_id", F.col("vec_id").alias("id"), F.lit("vector").alias("method"), F.greatest(F.col("cos"), F.lit(0.0)).alias("score"))
    merged = R.merge_scores(v.unionByName(k), ["query_id", "id"], {"vector": 0.3, "graph": 0.2, "ast": 0.2, "hybrid": 0.3})
    return R.top_per_group(merged, ["query_id"], [F.desc("combined_score"), F.asc("id")], TOP)


# ---- four methods over the laws that texts name ----

WEIGHTS = {"vector": 0.3, "graph": 0.2, "ast": 0.2, "hybrid": 0.3}
_METHOD_ROWS = f"""{C.LAWREFS}, q as (select src as query_uri, dst as uri from lr), nb as (select q.query_uri, x.dst as uri from q join lr x on q.uri = x.src where q.query_uri <> x.dst),
  m as (select query_uri, uri, 'vector' as method, 1.0 as score from q union all select distinct query_uri, uri, 'graph', 0.5 from nb
    union all select q.query_uri, q.uri, 'ast', 0.5 + 0.02 * (8 - (len(string_split(l.ast_path, '/')) - 1)) from q join l on q.uri = l.law_uri where l.ast_path is not null
    union all select q.query_uri, q.uri, 'hybrid', case when l.in_force then 0.8 else 0.4 end from q join l on q.uri = l.law_uri),
  f as (select query_uri, uri, sum(score * case method when 'vector' then 0.3 when 'hybrid' then 0.3 else 0.2 end) as sc, count(*) as n_methods, string_agg(method || '=' || printf('%.2f', score), ',' order by method) as scores from m group by 1, 2),
  z as (select query_uri, uri, round(case when n_methods > 1 then least(1.0, sc + 0.1 * (n_methods - 1)) else sc end, 6)::double as combined_score, n_methods, scores from f)"""


def _four_methods(s, d):
    """(query_uri, uri, method, score): laws for each citing law by its references, what these refer to, their paths and their force."""
    refs = materialize(C.law_references(s, d).select(F.col("src").alias("query_uri"), F.col("dst").alias("uri")))
    l = C.laws(s, d).select(F.col("law_uri").alias("uri"), "ast_path", "in_force")
    near = refs.join(refs.select(F.col("query_uri").alias("uri"), F.col("uri").alias("far")), "uri").where("query_uri <> far").select("query_uri", F.col("far").alias("uri")).distinct()
    known = refs.join(l, "uri")
    depth = F.size(F.split("ast_path", "/")) - 1
    row = lambda df, method, score: df.select("query_uri", "uri", F.lit(method).alias("method"), score.cast("double").alias("score"))
    return (
        row(refs, "vector", F.lit(1.0)).unionByName(row(near, "graph", F.lit(0.5)))
        .unionByName(row(known.where("ast_path is not null"), "ast", 0.5 + 0.02 * (8 - depth))).unionByName(row(known, "hybrid", F.when(F.col("in_force"), 0.8).otherwise(0.4)))
    )


@query(f"with {_METHOD_ROWS} select * from z qualify row_number() over (partition by query_uri order by combined_score desc, uri) <= {TOP}")
def merged_laws(s, d):
    """Four methods merged by law, with the score of each, and cut to the best of each query."""
    return R.top_per_group(R.merge_scores(_four_methods(s, d), ["query_uri", "uri"], WEIGHTS), ["query_uri"], [F.desc("combined_score"), F.asc("uri")], TOP)


@query(f"""with {_METHOD_ROWS}, b as (select z.*, round(z.combined_score * case when l.in_force then 1.2 else 1.0 end, 6)::double as boosted_score from z left join l on z.uri = l.law_uri)
select query_uri, uri, combined_score, boosted_score, least(boosted_score, 1.0)::double as confidence from b qualify row_number() over (partition by query_uri order by boosted_score desc, uri) <= {TOP}""")
def boosted_laws(s, d):
    """Merged results with a boost for laws in force, and a confidence of one at most."""
    z = R.merge_scores(_four_methods(s, d), ["query_uri", "uri"], WEIGHTS).join(C.laws(s, d).select(F.col("law_uri").alias("uri"), "in_force"), "uri", "left")
    b = z.withColumn("boosted_score", F.round(F.col("combined_score") * F.when(F.col("in_force"), 1.2).otherwise(1.0), 6))
    return R.top_per_group(b.select("query_uri", "uri", "combined_score", "boosted_score", F.least("boosted_score", F.lit(1.0)).alias("confidence")), ["query_uri"], [F.desc("boosted_score"), F.asc("uri")], TOP)


@query(f"with {_METHOD_ROWS}, t as (select *, row_number() over (partition by query_uri order by combined_score desc, uri) as r from z) select query_uri, uri, combined_score from t where combined_score < 0.5 and r > 5 qualify row_number() over (partition by query_uri order by combined_score desc, uri) <= 10")
def complementary_laws(s, d):
    """Low-scored results that the first five leave, ten a query."""
    z = R.merge_scores(_four_methods(s, d), ["query_uri", "uri"], WEIGHTS).select("query_uri", "uri", "combined_score")
    first = R.top_per_group(z, ["query_uri"], [F.desc("combined_score"), F.asc("uri")], 5).select("query_uri", "uri")
    rest = z.join(first, ["query_uri", "uri"], "left_anti").where("combined_score < 0.5")
    return R.top_per_group(rest, ["query_uri"], [F.desc("combined_score"), F.asc("uri")], 10)


@query(f"with {_METHOD_ROWS}, t as (select query_uri, count(*) as n, count(distinct scores) as d, count(distinct n_methods) as k from z group by 1) select query_uri, round((d * 1.0 / n + k * 1.0 / least(4, n)) / 2, 6)::double as diversity from t")
def merged_diversity(s, d):
    """Per query how many different sets of scores and numbers of methods its results have."""
    z = R.merge_scores(_four_methods(s, d), ["query_uri", "uri"], WEIGHTS)
    n = F.count(F.lit(1))
    return z.groupBy("query_uri").agg(F.round((F.count_distinct("scores") / n + F.count_distinct("n_methods") / F.least(F.lit(4), n)) / 2, 6).alias("diversity"))
