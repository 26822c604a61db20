"""Queries of the analysis stages: rules, graph search, citations, confidence, records as nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.sr import normalize_sr
from lexloom.functions.uris import article_number, law_designation, status_digit
from lexloom.operators import graph as G
from lexloom.operators import rules as X
from lexloom.operators.hierarchy import hierarchy
from lexloom.plans import catalogue as C
from lexloom.plans import problems as P
from lexloom.plans.problems import _designation, _number
from lexloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_RULES = f"""{C.ARTICLES}, f as (select uri, regexp_replace(content_full, '\\s+', ' ', 'g') as t from a where content_full is not null),
  x as (select uri, nullif(regexp_extract(t, '{_re(X.CONDITION)}', 1), '') as condition, nullif(regexp_extract(t, '{_re(X.EXCEPTION)}', 1), '') as exception,
    case when regexp_matches(t, '{X.PROHIBIT}') then 'SHALL_NOT' when regexp_matches(t, '{X.OBLIGE}') then 'SHALL' when regexp_matches(t, '{X.PERMIT}') then 'MAY' end as operator,
    try_cast(nullif(regexp_extract(t, '{X.LIMIT}', 1), '') as int) as limit_value, nullif(regexp_extract(t, '{X.LIMIT}', 2), '') as limit_unit from f)"""


def _rules(s, d):
    return C.articles(s, d).where("content_full is not null").select("uri", X.rule(F.col("content_full")).alias("r")).select("uri", "r.*")


@query(f"with {_RULES} select * from x")
def rules(s, d):
    return _rules(s, d)


@query(f"""with {_RULES} select uri, round(least(1.0, 0.5 + 0.2 * (operator is not null)::int + 0.1 * (condition is not null)::int + 0.15 * (exception is not null)::int + 0.2 * (limit_value is not null)::int
  + 0.1 * (operator is not null and condition is not null)::int), 6)::double as rule_score from x""")
def rule_scores(s, d):
    return _rules(s, d).select("uri", F.round(X.rule_score(F.col("operator"), F.col("condition"), F.col("exception"), F.col("limit_value")), 6).alias("rule_score"))


_H = "case when sr like '101%' then 0.5 when sr like '210%' or sr like '220%' then 0.7 when sr is null then 1.0 else 0.9 end"


@query(f"""with recursive {C.LAWREFS}, {C._SEEDS}, w as (select src as a, dst as b from lr union select dst, src from lr),
  b as (select seed, seed as node, 0 as length from seeds union select b.seed, w.b, b.length + 1 from b join w on b.node = w.a where b.length < 2),
  p as (select node, min(length) as length from b where node <> seed group by 1), q as (select p.*, nullif(regexp_replace(regexp_replace(l.sr_number, '\\s+', '', 'g'), '^(?i)(SR|RS)', ''), '') as sr from p left join l on p.node = l.law_uri)
select node, length, round(1.0 / (1 + length) * (2 - {_H}), 6)::double as path_score from q where length > 0""")
def graph_search(s, d):
    """Laws near the seeds along references, scored by distance and rank of the law."""
    near = C.reference_neighbourhood(s, d).groupBy("node").agg(F.max("score").alias("score"))
    l = C.laws(s, d).select(F.col("law_uri").alias("node"), normalize_sr(F.col("sr_number")).alias("sr"))
    h = F.when(F.col("sr").startswith("101"), 0.5).when(F.col("sr").startswith("210") | F.col("sr").startswith("220"), 0.7).when(F.col("sr").isNull(), 1.0).otherwise(0.9)
    length = F.round(1 / F.col("score") - 1).cast("int")
    return near.join(l, "node", "left").select("node", length.alias("length"), F.round(1 / (1 + length) * (2 - h), 6).alias("path_score"))


@query("""with x as (select doc_id, regexp_extract_all(text, '(?:Artikel|[Aa]rticle|articolo|Art\\.)\\s+(\\d+[a-z]*)', 1) as refs from documents where text is not null)
select doc_id, len(refs)::int as n_refs, refs[1] as first_ref from x""")
def text_citations(s, d):
    """Articles that the texts cite."""
    refs = F.regexp_extract_all("text", F.lit(r"(?:Artikel|[Aa]rticle|articolo|Art\.)\s+(\d+[a-z]*)"), F.lit(1))
    return table(s, d, "documents").where("text is not null").select("doc_id", refs.alias("r")).select("doc_id", F.size("r").alias("n_refs"), F.try_element_at("r", F.lit(1)).alias("first_ref"))


@query(f"""with {C.REFS}, c as (select distinct {_designation('target_law')} as law, {_number('target_article')} as article from r)
select law, article, case when starts_with(law, 'sr:') then concat_ws(' ', 'Art. ' || article, 'SR ' || substr(law, 4)) when starts_with(law, 'abbr:') then concat_ws(' ', 'Art. ' || article, substr(law, 6)) else concat_ws(' ', 'Art. ' || article, law) end as citation from c where law is not null""")
def formatted_citations(s, d):
    c = C.references(s, d).select(law_designation(F.col("target_law")).alias("law"), article_number(F.col("target_article")).alias("article")).where("law is not null").distinct()
    name = F.regexp_replace(F.regexp_replace("law", "^sr:", "SR "), "^abbr:", "")
    return c.select("law", "article", F.concat_ws(" ", F.concat(F.lit("Art. "), "article"), name).alias("citation"))


_CONF = f"""{C.REFS}, {C.LAWS}, {C.LAWNAMES}, k as (select r.source_law, count(*) as n, avg((({_designation('target_law')} is not null)::int + ({_number('target_article')} is not null)::int) / 2.0) as filled,
    count(*) filter (regexp_extract(l.in_force_status, '(\\d)/?\\s*$', 1) = '3') as repealed, count(distinct r.lang) as langs, avg(confidence) as conf from r left join names on {_designation('target_law')} = names.name left join l on names.target = l.law_uri where source_law is not null group by 1),
  s as (select source_law, case when n < 2 then 0.5 else least(1.0, 0.5 + 0.1 * langs) end as agreement, 0.5 + 0.3 * filled as citation, greatest(0, 0.7 - 0.5 * repealed / n) as temporal, case when n < 3 then 0.4 when n > 10 then 0.7 else 0.5 end as coverage, conf from k)"""


@query(f"""with {_CONF}, w as (select source_law, round(0.25 * agreement + 0.2 * citation + 0.15 * temporal + 0.2 * coverage + 0.2 * conf + 1e-9, 4)::double as confidence from s)
select source_law, confidence, case when confidence >= 0.9 then 'very high' when confidence >= 0.75 then 'high' when confidence >= 0.6 then 'moderate' when confidence >= 0.4 then 'low' else 'very low' end as level from w""")
def citing_confidence(s, d):
    """Confidence in what a law cites: agreement of languages, complete citations, validity, coverage and extraction."""
    r = C.references(s, d).where("source_law is not null").withColumns({"target": law_designation(F.col("target_law")), "number": article_number(F.col("target_article"))})
    l = C.laws(s, d).select(F.col("law_uri").alias("target"), status_digit(F.col("in_force_status")).alias("st"))
    n = F.count(F.lit(1))
    filled = F.avg((F.col("target").isNotNull().cast("int") + F.col("number").isNotNull().cast("int")) / 2)
    names = C.law_names(s, d).select(F.col("name").alias("target"), F.col("target").alias("law"))
    k = r.join(names, "target", "left").join(l.withColumnRenamed("target", "law"), "law", "left").groupBy("source_law").agg(n.alias("n"), filled.alias("filled"), F.count_if(F.col("st") == "3").alias("repealed"), F.countDistinct("lang").alias("langs"), F.avg("confidence").alias("conf"))
    agreement = F.when(F.col("n") < 2, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + 0.1 * F.col("langs")))
    temporal = F.greatest(F.lit(0.0), 0.7 - 0.5 * F.col("repealed") / F.col("n"))
    covered = F.when(F.col("n") < 3, 0.4).when(F.col("n") > 10, 0.7).otherwise(0.5)
    score = F.round(0.25 * agreement + 0.2 * (0.5 + 0.3 * F.col("filled")) + 0.15 * temporal + 0.2 * covered + 0.2 * F.col("conf") + 1e-9, 4)
    level = F.when(score >= 0.9, "very high").when(score >= 0.75, "high").when(score >= 0.6, "moderate").when(score >= 0.4, "low").otherwise("very low")
    return k.select("source_law", score.alias("confidence"), level.alias("level"))


@query(f"with recursive {P._LINKS}, x as (select root, count(*) as n_nodes, max(depth)::bigint as height from t group by 1) select root as root_uri, n_nodes, height from x where n_nodes > 1")
def tree_sizes(s, d):
    """Closure of containment: what lies below each root."""
    tree = hierarchy(P.law_tree_links(s, d), "node_uri", "parent_uri").where("not cyclic")
    return tree.groupBy(F.col("root").alias("root_uri")).agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("height")).where("n_nodes > 1")


@query(f"""with {C.LAWS}, n as (select law_uri, regexp_replace(regexp_replace(sr_number, '\\s+', '', 'g'), '^(?i)(SR|RS)', '') as sr from l)
select law_uri, sr, case when sr = '101' or sr like '101.%' then 1 when sr like '210%' or sr like '220%' then 2 when sr like '235%' then 3 else 4 end as seed_rank from n where sr is not null order by seed_rank, sr, law_uri limit 25""")
def seed_laws(s, d):
    sr = normalize_sr(F.col("sr_number"))
    l = C.laws(s, d).select("law_uri", sr.alias("sr")).where("sr is not null")
    rank = F.when((F.col("sr") == "101") | F.col("sr").startswith("101."), 1).when(F.col("sr").startswith("210") | F.col("sr").startswith("220"), 2).when(F.col("sr").startswith("235"), 3).otherwise(4)
    return l.withColumn("seed_rank", rank).orderBy("seed_rank", "sr", "law_uri").limit(25)


@query("select label, count(*) as n_vectors, count(embedding) as with_embedding, max(len(embedding))::int as dimensions from embeddings group by 1")
def embedding_statistics(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"), F.count("embedding").alias("with_embedding"), F.max(F.size("embedding")).alias("dimensions"))


@query("""select printf('stage_total{stage="%s"} %d', event_type, count(*)) as line from events group by event_type""")
def metric_lines(s, d):
    """Stage counts in a text exposition format."""
    n = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.format_string('stage_total{stage="%s"} %d', "event_type", "n").alias("line"))


@query(f"""with {C._METHODS} select round((count(distinct methods) * 1.0 / count(*) + 1.0 / least(4, count(*))) / 2, 6)::double as diversity from f""")
def result_diversity(s, d):
    m = C.R.merge_methods(C._method_results(s, d), {"vector": 0.3, "hybrid": 0.3})
    return m.agg(F.round((F.countDistinct("methods") / F.count(F.lit(1)) + 1 / F.least(F.lit(4), F.count(F.lit(1)))) / 2, 6).alias("diversity"))


@query(f"""with {C._METHODS_ALL} select query_id, round((count(distinct methods) * 1.0 / count(*) + 1.0 / least(4, count(*))) / 2, 6)::double as diversity from f group by 1""")
def result_diversity_all(s, d):
    n = F.count(F.lit(1))
    return C._all_merged(s, d).groupBy("query_id").agg(F.round((F.countDistinct("methods") / n + 1 / F.least(F.lit(4), n)) / 2, 6).alias("diversity"))


_EDGE_TYPES = {"isRealizedBy": "EXPRESSED_IN", "isEmbodiedBy": "MANIFESTED_AS", "isExemplifiedBy": "CONTAINS", "isMemberOf": "HAS_VERSION", "consolidationAbstract": "AMENDS", "impacts": "AMENDS", "basicAct": "BASED_ON", "classifiedByTaxonomyEntry": "CLASSIFIED_BY"}


_VALUES = f"with recursive {P._SUBJECTS}"
_EDGES = f"""{_VALUES}, e as (select distinct case when entry_name = 'isMemberOf' then entry_value else subject_uri end as src, case when entry_name = 'isMemberOf' then subject_uri else entry_value end as dst,
  case entry_name {' '.join(f"when '{k}' then '{v}'" for k, v in _EDGE_TYPES.items())} end as type from x where entry_name in ({', '.join(f"'{k}'" for k in _EDGE_TYPES)}))"""
_LAW_FIELDS = ["dateDocument", "dateEntryInForce", "dateNoLongerInForce", "dateApplicability", "dateEndApplicability", "inForceStatus", "typeDocument", "title", "titleShort"]


@query(f"{_EDGES} select * from e")
def json_edges(s, d):
    """Typed edges between the subjects of the linked-data records; HAS_VERSION points from law to version."""
    v = P.record_values(s, d).where(F.col("entry_name").isin(*_EDGE_TYPES))
    kinds = F.create_map(*[F.lit(x) for pair in _EDGE_TYPES.items() for x in pair])
    turned = F.col("entry_name") == "isMemberOf"
    return v.select(F.when(turned, F.col("entry_value")).otherwise(F.col("subject_uri")).alias("src"), F.when(turned, F.col("subject_uri")).otherwise(F.col("entry_value")).alias("dst"), F.try_element_at(kinds, F.col("entry_name")).alias("type")).distinct()


@query(f"{_VALUES} select subject_uri, {', '.join(f"""min(entry_value) filter (entry_name = '{n}') as {n}""" for n in _LAW_FIELDS)}, count(distinct record_id) as n_records from x group by 1")
def json_laws(s, d):
    """One row per subject with its dates, status and titles as columns."""
    v = P.record_values(s, d)
    return v.groupBy("subject_uri").agg(*[F.min(F.when(F.col("entry_name") == n, F.col("entry_value"))).alias(n) for n in _LAW_FIELDS], F.countDistinct("record_id").alias("n_records"))


@query(f"{_EDGES} select type, count(*) as n from e group by 1")
def json_edge_counts(s, d):
    return G.count_by(json_edges(s, d), "type")
