"""Queries on what texts say: references of every kind, rules sentence by sentence, formats of citations, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import citations as X
from lexloom.functions.sr import normalize_sr
from lexloom.functions.text import STOP_WORDS
from lexloom.functions.uris import article_number, law_designation
from lexloom.plans import catalogue as C
from lexloom.plans.problems import _designation, _number
from lexloom.session import dealt, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HITS = " union all ".join(
    f"select doc_id, '{kind}' as kind, generate_subscripts(r, 1)::int as position, unnest(r) as raw, unnest(a) as value, unnest(b) as second, {conf}::double as confidence from (select doc_id, regexp_extract_all(text, {_q(p)}, 0) as r, regexp_extract_all(text, {_q(p)}, 1) as a, regexp_extract_all(text, {_q(p)}, 2) as b from documents where text is not null)"
    for kind, (p, conf) in X.REFERENCE_KINDS.items()
)


def _references(s, d):
    hits = dealt(table(s, d, "documents")).where("text is not null").select("doc_id", F.explode(X.text_references(F.col("text"))).alias("h"))
    return hits.select("doc_id", "h.*")


@query(f"with h as ({_HITS}) select * from h")
def text_references(s, d):
    """Every reference in every text: ranges, paragraphs, law codes, numbers, letters, SR numbers and publications."""
    return _references(s, d)


@query(f"with h as ({_HITS}) select kind, confidence, count(*) as n_hits, count(distinct doc_id) as n_docs, count(distinct value) as n_values from h group by 1, 2")
def text_reference_counts(s, d):
    return _references(s, d).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("value").alias("n_values"))


@query(f"with {C.REFS}, p as (select ref_id, context_text, raw_text, instr(context_text, raw_text) as i from r where context_text is not null and raw_text is not null and raw_text <> '') select ref_id, i::int as found_at, substr(context_text, greatest(1, i - 20), length(raw_text) + 20 + least(20, i - 1)) as around from p where i > 0")
def reference_contexts(s, d):
    """Where each reference stands in its context, with twenty characters on either side."""
    p = C.references(s, d).where("context_text is not null and raw_text is not null and raw_text <> ''").withColumn("i", F.expr("instr(context_text, raw_text)")).where("i > 0")
    return p.select("ref_id", F.col("i").alias("found_at"), F.expr("substr(context_text, greatest(1, i - 20), length(raw_text) + 20 + least(20, i - 1))").alias("around"))


_SENTENCES = f"""{C.ARTICLES}, s0 as (select uri, lang, regexp_extract_all(regexp_replace(regexp_replace(content_full, '\\s+', ' ', 'g'), {_q(X.ABBREVIATIONS)}, '\\1', 'g'), {_q(X.SENTENCE)}) as ss from a where content_full is not null and lang in ('de', 'fr', 'it')),
  s as (select uri, lang, generate_subscripts(ss, 1)::int as sentence_no, unnest(ss) as st from s0)"""
_PARTS = " union all ".join(
    f"select uri, sentence_no, '{kind}' as kind, generate_subscripts(h, 1)::int as position, unnest(h) as part_text from (select uri, sentence_no, regexp_extract_all(st, {_q(p)}, 1) as h from s where lang = '{lang}')"
    for kind, patterns in X.RULE_KINDS.items()
    for lang, p in patterns.items()
)
_RULES = f"{_SENTENCES}, p as ({_PARTS})"


def _rule_parts(s, d):
    a = C.articles(s, d).where("content_full is not null and lang in ('de', 'fr', 'it')").select("uri", "lang", F.posexplode(X.sentences(F.col("content_full"))).alias("i", "st"))
    return a.select("uri", (F.col("i") + 1).alias("sentence_no"), F.explode(X.rule_parts(F.col("st"), F.col("lang"))).alias("p")).select("uri", "sentence_no", "p.kind", "p.position", F.col("p.text").alias("part_text"))


@query(f"with {_RULES} select * from p")
def rule_parts(s, d):
    """All conditions, consequences, exceptions, times, obligations, permissions and prohibitions of every sentence."""
    return _rule_parts(s, d)


def _n(kind: str):
    return F.count_if(F.col("kind") == kind)


_COUNTS = ", ".join(f"count(*) filter (kind = '{k}') as n_{k.lower()}" for k in X.RULE_KINDS)
_SCORE = """round(least(1.0, 0.5 + 0.2 * ((n_obligation > 0)::int + (n_permission > 0)::int + (n_prohibition > 0)::int) + 0.1 * least(n_condition, 2) + 0.15 * least(n_exception, 2) + 0.2 * (n_temporal > 0)::int
  + 0.1 * (n_condition > 0 and n_consequence > 0)::int + 0.05 * (n_exception > 0)::int), 6)::double"""


def _rule_counts(s, d):
    n = _rule_parts(s, d).groupBy("uri").agg(*[_n(k).alias(f"n_{k.lower()}") for k in X.RULE_KINDS])
    has = lambda c: (F.col(c) > 0).cast("int")
    score = 0.5 + 0.2 * (has("n_obligation") + has("n_permission") + has("n_prohibition")) + 0.1 * F.least("n_condition", F.lit(2)) + 0.15 * F.least("n_exception", F.lit(2)) + 0.2 * has("n_temporal")
    score = score + 0.1 * ((F.col("n_condition") > 0) & (F.col("n_consequence") > 0)).cast("int") + 0.05 * has("n_exception")
    return n.withColumn("rule_score", F.round(F.least(F.lit(1.0), score), 6))


@query(f"with {_RULES}, n as (select uri, {_COUNTS} from p group by 1) select *, {_SCORE} as rule_score from n")
def rule_part_scores(s, d):
    """Scores of articles as rules from all their parts, up to two conditions and exceptions counted."""
    return _rule_counts(s, d)


@query(f"with {_RULES}, n as (select uri, {_COUNTS} from p group by 1), k as (select uri, {_SCORE} as rule_score, n_condition, n_exception from n) select uri, rule_score from k order by rule_score desc, n_condition desc, n_exception desc, uri limit 50")
def top_rules(s, d):
    """Rule search: the fifty best scored articles."""
    return _rule_counts(s, d).orderBy(F.desc("rule_score"), F.desc("n_condition"), F.desc("n_exception"), "uri").limit(50).select("uri", "rule_score")


@query(f"""with {_RULES}, k as (select uri, concat_ws(' | ', 'IF ' || string_agg(part_text, ' AND ' order by sentence_no, position) filter (kind = 'CONDITION'), 'THEN ' || string_agg(part_text, ' AND ' order by sentence_no, position) filter (kind = 'CONSEQUENCE'),
    'EXCEPT ' || string_agg(part_text, ' AND ' order by sentence_no, position) filter (kind = 'EXCEPTION')) as rule_text, {_COUNTS} from p group by 1)
select uri, rule_text, concat_ws('; ', case when n_condition > 0 then n_condition || ' conditions' end, case when n_exception > 0 then n_exception || ' exceptions' end, case when n_temporal > 0 then n_temporal || ' times' end,
  case when n_prohibition > 0 then 'prohibits' when n_obligation > 0 then 'obliges' when n_permission > 0 then 'permits' end) as reasoning from k""")
def rule_texts(s, d):
    """Rules as text and why they matter; an article's parts are bounded by its text."""
    joined = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("sentence_no", "position", "part_text")))), lambda x: x["part_text"]), " AND ")
    part = lambda head, kind: F.when(_n(kind) > 0, F.concat(F.lit(head), joined(kind)))
    told = lambda kind, word: F.when(_n(kind) > 0, F.concat(_n(kind).cast("string"), F.lit(word)))
    verb = F.when(_n("PROHIBITION") > 0, "prohibits").when(_n("OBLIGATION") > 0, "obliges").when(_n("PERMISSION") > 0, "permits")
    return _rule_parts(s, d).groupBy("uri").agg(
        F.concat_ws(" | ", part("IF ", "CONDITION"), part("THEN ", "CONSEQUENCE"), part("EXCEPT ", "EXCEPTION")).alias("rule_text"),
        F.concat_ws("; ", told("CONDITION", " conditions"), told("EXCEPTION", " exceptions"), told("TEMPORAL", " times"), verb).alias("reasoning"),
    )


_TITLE = C._sql_title
_FORMATS = f"""{C.LAWS}, {C.REFS}, c as (select distinct {_designation('target_law')} as law, {_number('target_article')} as article from r), ab as (select upper(abbreviation) as abbr, min(sr_number) as sr from code_articles group by 1), sb as (select sr_number as sr, min(upper(abbreviation)) as abbr from code_articles group by 1),
  f as (select c.law, article, coalesce(case when starts_with(c.law, 'sr:') then substr(c.law, 4) end, ab.sr, {C.SR_SQL}) as sr, coalesce({_TITLE('title_de')}, {_TITLE('title_fr')}, {_TITLE('title_it')}) as title, case when starts_with(c.law, 'abbr:') then substr(c.law, 6) end as named
    from c left join ab on c.law = 'abbr:' || ab.abbr left join l on c.law = l.law_uri where c.law is not null),
  g as (select f.*, coalesce(named, sb.abbr) as abbr from f left join sb on f.sr = sb.sr), h as (select *, case when article is not null and abbr is not null then 'Art. ' || article || ' ' || abbr when sr is not null then concat_ws(' ', 'SR ' || sr, 'Art. ' || article) when article is not null then 'Art. ' || article else coalesce(abbr, law) end as standard from g)"""


@query(f"with {_FORMATS} select law, article, standard, concat_ws(' ', standard, '(' || title || ')') as full_form, concat_ws(':', sr, article) as compact, case when abbr is not null and article is null then abbr else standard end as challenge from h")
def citation_formats(s, d):
    """Each cited provision in the four formats: standard, full with title, compact, and by abbreviation alone where no article is named."""
    c = C.references(s, d).select(law_designation(F.col("target_law")).alias("law"), article_number(F.col("target_article")).alias("article")).where("law is not null").distinct()
    codes = table(s, d, "code_articles")
    ab = codes.groupBy(F.concat(F.lit("abbr:"), F.upper("abbreviation")).alias("law")).agg(F.min("sr_number").alias("code_sr"))
    sb = codes.groupBy(F.col("sr_number").alias("sr")).agg(F.min(F.upper("abbreviation")).alias("code_abbr"))
    titles = F.coalesce(*[C._real_title(t) for t in ("title_de", "title_fr", "title_it")])
    l = C.laws(s, d).select(F.col("law_uri").alias("law"), normalize_sr(F.col("sr_number")).alias("law_sr"), titles.alias("title"))
    f = c.join(ab, "law", "left").join(l, "law", "left").withColumn("sr", F.coalesce(F.when(F.col("law").startswith("sr:"), F.expr("substr(law, 4)")), "code_sr", "law_sr"))
    g = f.join(sb, "sr", "left").withColumn("abbr", F.coalesce(F.when(F.col("law").startswith("abbr:"), F.expr("substr(law, 6)")), "code_abbr"))
    art = F.concat(F.lit("Art. "), "article")
    standard = F.when(F.col("article").isNotNull() & F.col("abbr").isNotNull(), F.concat_ws(" ", art, "abbr")).when(F.col("sr").isNotNull(), F.concat_ws(" ", F.concat(F.lit("SR "), "sr"), art)).when(F.col("article").isNotNull(), art).otherwise(F.coalesce("abbr", "law"))
    g = g.withColumn("standard", standard)
    return g.select("law", "article", "standard", F.concat_ws(" ", "standard", F.concat(F.lit("("), "title", F.lit(")"))).alias("full_form"), F.concat_ws(":", "sr", "article").alias("compact"), F.when(F.col("abbr").isNotNull() & F.col("article").isNull(), F.col("abbr")).otherwise(F.col("standard")).alias("challenge"))


@query(f"with {_FORMATS} select law, coalesce(min(title), law) as title, count(article) as n_articles, string_agg(article, ', ' order by article) as articles from h group by law")
def bibliography_articles(s, d):
    """What is cited of each law: its title and all articles, in order; distinct articles of one law are few."""
    c = citation_formats(s, d)
    title = F.regexp_extract("full_form", r" \((.*)\)$", 1)
    articles = F.array_join(F.array_sort(F.collect_set("article")), ", ")
    return c.groupBy("law").agg(F.coalesce(F.min(F.nullif(title, F.lit(""))), "law").alias("title"), F.count("article").alias("n_articles"), F.nullif(articles, F.lit("")).alias("articles"))


_NUM = r"(?i)\b(\d+)\s*"
_UNITS = {"days": r"(?:tage?n?|jours?|giorni|days?)\b", "weeks": r"(?:wochen?|semaines?|settimane|weeks?)\b", "months": r"(?:monate?n?|mois|mesi|months?)\b", "years": r"(?:jahre?n?|ans|anni|years?)\b"}
_ARTICLE = r"\b[Aa]rt(?:ikel|icle|icolo|\.)\s*(\d+[a-z]?)"
_SUBJECT = r"(?i)\b(arbeitgeber|arbeitnehmer|mieter|vermieter|halter|verein|betreiber|eigentümerschaft|employeur|locataire|propriétaire|employer|tenant|owner|operator)"


@query("select item_id, " + ", ".join(f"try_cast(nullif(regexp_extract(text, {_q(_NUM + u)}, 1), '') as bigint) as {n}" for n, u in _UNITS.items()) + f", nullif(regexp_extract(text, {_q(_ARTICLE)}, 1), '') as article, nullif(regexp_extract(text, {_q(X.REFERENCE_KINDS['sr'][0])}, 1), '') as sr, lower(nullif(regexp_extract(text, {_q(_SUBJECT)}, 1), '')) as subject from eval_items where text is not null")
def question_entities(s, d):
    """What each test question names: spans of time, article, number of a law and the first subject."""
    got = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    q = table(s, d, "eval_items").where("text is not null")
    return q.select("item_id", *[got(_NUM + u).try_cast("bigint").alias(n) for n, u in _UNITS.items()], got(_ARTICLE).alias("article"), got(X.REFERENCE_KINDS["sr"][0]).alias("sr"), F.lower(got(_SUBJECT)).alias("subject"))


#: Keywords of a question: so many, the first.
KEYWORDS = 10
_STOP = sorted({w for words in STOP_WORDS.values() for w in words.split()})


def keywords(text):
    """The first KEYWORDS distinct words of more than two letters that are no stop words, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(_STOP))), 1, KEYWORDS)


_KEYS = f"k0 as (select item_id, list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda w: length(w) > 2 and w not in ({', '.join(map(_q, _STOP))})) as ws from eval_items where text is not null), k1 as (select item_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from k0), k2 as (select item_id, word, min(i) as i from k1 group by 1, 2), k as (select item_id, word, row_number() over (partition by item_id order by i)::int as place from k2 qualify place <= {KEYWORDS})"


@query(f"with {_KEYS} select * from k")
def question_keywords(s, d):
    return table(s, d, "eval_items").where("text is not null").select("item_id", F.posexplode(keywords(F.col("text"))).alias("i", "word")).select("item_id", "word", (F.col("i") + 1).alias("place"))


@query(f"""with {C.LAWS}, {_KEYS}, w as (select distinct law_uri, unnest(regexp_extract_all(lower(concat_ws(' ', title_de, title_fr, title_it, title_en)), '[a-zà-ÿ]+')) as word from l)
select item_id, law_uri, count(*) as n_words from k join w using (word) group by 1, 2 qualify row_number() over (partition by item_id order by n_words desc, law_uri) <= 10""")
def question_seeds(s, d):
    """The ten laws whose titles share most keywords with each question; the questions are a stated set, their words are sent to the titles."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title_de", "title_fr", "title_it", "title_en")), F.lit("[a-zà-ÿ]+"), F.lit(0)))
    w = C.laws(s, d).select("law_uri", F.explode(words).alias("word"))
    n = question_keywords(s, d).join(w, "word").groupBy("item_id", "law_uri").agg(F.count(F.lit(1)).alias("n_words"))
    return C.R.top_per_group(n, ["item_id"], [F.desc("n_words"), F.asc("law_uri")], 10)
