"""Question analysis as column expressions: intent, entities, complexity, ambiguity, missing context, strategy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, down to FALLBACKS: patterns of the intents (lower-case text), their weights, hints of ambiguity, entities, and the
# words that complexity, ambiguity and missing context are told by. They must match for the same question to get the same answer.
INTENTS = {
    "factual": (0.9, [r"\bwhat\s+(?:is|are)\b", r"\bwhich\s+(?:law|article|section)\b", r"\btell\s+me\s+about\b", r"\bexplain\b"]),
    "comparative": (1.5, [r"\bdifference\s+between\b", r"\bcompare\b", r"\bversus\b|\bvs\b", r"\bsimilar(?:ity|ities)?\b", r"\bhow\s+does\s+.*\s+differ\b"]),
    "procedural": (1.3, [r"\bhow\s+(?:to|do|can)\b", r"\bsteps\s+(?:to|for)\b", r"\bprocess\s+(?:for|of)\b", r"\brequirements?\s+(?:for|to)\b", r"\bprocedure\b"]),
    "exploratory": (0.8, [r"\boverview\b", r"\bsummar(?:y|ize)\b", r"\bgeneral\s+information\b", r"\bbackground\b", r"\bcontext\b"]),
    "definitional": (1.0, [r"\bdefin(?:e|ition)\b", r"\bwhat\s+(?:is|are)\s+(?:a|an|the)?\b", r"\bmean(?:s|ing)?\b", r"\bstand\s+for\b"]),
    "temporal": (1.3, [r"\bwhen\s+(?:was|did|will)\b", r"\bsince\s+when\b", r"\bsince\s+\d{4}\b", r"\bhistorical\b", r"\btimeline\b", r"\bhistory\b", r"\bchanges?\s+(?:over\s+time|since|to)\b"]),
    "jurisdictional": (1.1, [r"\bwhere\b", r"\bjurisdiction\b", r"\bappl(?:y|ies|icable)\s+(?:to|in)\b", r"\bscope\b", r"\bterritor(?:y|ial)\b"]),
    "relationship": (1.2, [r"\brelat(?:e|ed|ion|ionship)?\b", r"\bconnect(?:ed|ion)\b", r"\blink(?:ed|s)?\b", r"\bassociat(?:e|ed|ion)\b", r"\bdepend(?:s|ent|ency|encies)\b", r"\bbetween\s+\w+\s+(?:law|article|regulation)"]),
}
AMBIGUITY = [r"\b(?:any|some|certain)\b", r"\b(?:might|maybe|perhaps|possibly)\b", r"\b(?:generally|usually|typically)\b", r"\b(?:or|and/or)\b", r"\b(?:etc|and so on)\b", r"\b(?:kinds? of|types? of|forms? of)\b"]
ARTICLE = r"\b(?:art(?:icle)?|artikel)\.?\s*(\d+(?:\.\d+)?(?:[a-z])?)"
SECTION = r"\b(?:section|paragraph|§)\s*(\d+(?:\.\d+)?)"
LAW = r"\b((?:Civil\s+Code|Federal\s+Act|Tax\s+Law|Criminal\s+Code|Constitution|[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,5}\s+(?:Law|Act|Code|Statute)))"
CHAPTER = r"\b(?:chapter|titel|title)\s+(\d+|[IVXLCDM]+)"
DATE = r"\b(\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4})"
# names of laws have six words before their kind at most, so that long texts are read in linear time
ENTITIES = {"articles": ARTICLE, "laws": LAW, "dates": DATE, "sections": SECTION, "chapters": CHAPTER}
CONNECTIVES, CONTRAST, CONDITIONAL = r"[,;]|\band\b|\bor\b", r"\b(compar|differ|versus|between)\b", r"\b(if|when|unless|except|but)\b"
VAGUE, PRONOUNS = r"\b(many|few|several|various|numerous|multiple)\b", r"\b(it|they|them|this|that|these|those)\b"
RECENT, SPECIFIC, SCOPED = r"\b(recent|current|old|new|latest|previous)\b", r"\b(citizenship|immigration|tax|property)\b", r"\brequirements?\b"
STRATEGIES = {"factual": "vector", "comparative": "graph", "procedural": "vector", "exploratory": "hybrid", "definitional": "vector", "temporal": "graph", "jurisdictional": "ast", "relationship": "graph"}
FALLBACKS = {"factual": "ast", "comparative": "vector_graph", "procedural": "hybrid", "exploratory": "vector_graph", "definitional": "ast", "temporal": "hybrid", "jurisdictional": "vector_ast", "relationship": "graph_ast"}


#: Letters with marks and what they are read as, so that a word's edge is the same in every engine.
MARKED, BARE = "äöüàâáéèêëíìîïóòôúùûçñÄÖÜÀÂÉÈÊËÎÏÔÙÛÇ", "aouaaaeeeeiiiiooouuucnAOUAAEEEEIIOUUC"


def plain_text(text: Column) -> Column:
    """A text with single blanks, without marks on its letters, other signs but § read as blanks."""
    bare = F.regexp_replace(F.translate(text, MARKED, BARE), "[\u0300-\u036f]", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^ -~§]", " "), " +", " ")


def _hits(low: Column, patterns: list[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total += low.rlike(p).cast("int")
    return total


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(1))


def intent_scores(text: Column) -> Column:
    """Array of (score, order, name, hits) of all intents; keep it as a column, as several answers read it."""
    low = F.lower(text)
    hits = F.array(*[_hits(low, patterns) for _, patterns in INTENTS.values()])
    weights, names = F.array(*[F.lit(w) for w, _ in INTENTS.values()]), F.array(*[F.lit(n) for n in INTENTS])
    return F.transform(hits, lambda h, i: F.struct((h * F.get(weights, i)).alias("score"), (-i).alias("order"), F.get(names, i).alias("name"), h.alias("hits")))


def intent(scored: Column) -> Column:
    """(intent, confidence) of :func:`intent_scores`: the heaviest sum of matches, ties to the first listed; none is exploratory at 0.5."""
    best = F.array_max(scored)
    kinds = F.size(F.filter(scored, lambda s: s["hits"] > 0))
    base = F.when(best["hits"] >= 2, 0.8).otherwise(0.6)
    base = F.when(kinds == 1, F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    base = F.when(best["name"].isin("comparative", "procedural"), F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    return F.when(kinds == 0, F.struct(F.lit("exploratory").alias("intent"), F.lit(0.5).alias("confidence"))).otherwise(F.struct(best["name"].alias("intent"), base.alias("confidence")))


def entities(text: Column) -> Column:
    """What a question names: articles, laws, dates, sections and chapters."""
    return F.struct(*[_all(text, pattern).alias(name) for name, pattern in ENTITIES.items()])


def complexity(text: Column, n_entities: Column) -> Column:
    words = F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))
    score = F.when(words > 30, 2).when(words > 15, 1).otherwise(0) + F.when(n_entities > 3, 2).when(n_entities > 1, 1).otherwise(0)
    score += (F.regexp_count(text, F.lit(CONNECTIVES)) > 2).cast("int")
    score += text.rlike(f"(?i){CONTRAST}").cast("int") + text.rlike(f"(?i){CONDITIONAL}").cast("int")
    return F.when(score >= 3, "complex").when(score >= 2, "medium").otherwise("simple")


def ambiguity(text: Column) -> Column:
    total = F.lit(0.0)
    for p in AMBIGUITY:
        total += text.rlike(f"(?i){p}").cast("int") * 1.5
    total += text.rlike(f"(?i){VAGUE}").cast("int") * 1.0
    total += text.rlike(f"(?i){PRONOUNS}").cast("int") * 0.5
    total += F.lower(text).contains("maybe").cast("int") * 2.0
    return F.least(F.lit(1.0), total / (len(AMBIGUITY) * 1.5 + 3.5))


def missing_context(text: Column, n_dates: Column, n_laws: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(
        F.when(low.rlike(RECENT) & (n_dates == 0), "time_period"),
        F.when(~low.rlike("swiss|switzerland") & low.rlike("law|legal|statute|regulation"), "jurisdiction"),
        F.when(low.rlike(SPECIFIC) & ~low.rlike("naturalization|visa|income|real estate"), "specific_type"),
        F.when(low.rlike(SCOPED) & (n_laws == 0), "specific_law_or_context"),
    ))


def strategy(intent_name: Column, has_article: Column, ambiguous: Column, level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    s = F.try_element_at(table, intent_name)
    s = F.when(has_article, "ast").when(intent_name.isin("definitional", "factual"), "vector").otherwise(s)
    return F.when((ambiguous > 0.6) | (level == "complex"), "hybrid").otherwise(s)


def fallback(intent_name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FALLBACKS.items() for x in pair]), intent_name)


#: What to ask for what is missing, by priority, and how many questions at most.
CLARIFICATIONS = {"jurisdiction": "Which jurisdiction does the question concern?", "specific_law_or_context": "Which law or situation is meant?", "specific_type": "Which kind of case is it?", "time_period": "Which date or period is meant?"}
MOST_CLARIFICATIONS = 3
