"""References and rules in texts: what each pattern finds, all hits in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ART = r"\b[Aa]rt(?:ikel|icles?|icoli|icolo|\.)?\s*"
# Kinds of references in de, fr, it and en, each with two groups, and the confidence in them.
REFERENCE_KINDS = {
    "article_range": (_ART + r"(\d+[a-z]?)\s*(?:-|–|bis|à|to)\s*(\d+[a-z]?)\b", 0.9),
    "article_paragraph": (_ART + r"(\d+[a-z]?)\s+(?:Abs|al|cpv|para)\.?\s*(\d+)", 0.9),
    "article_law": (_ART + r"(\d+[a-z]?)\s+([A-Z]{2,6})\b", 0.9),
    "article_of": (_ART + r"(\d+[a-z]?)\s+(?:der|des|du|de la|del|della|of the)\s+([A-Za-zÀ-ÿ]+)", 0.9),
    "article": (_ART + r"(\d+[a-z]*)()", 0.9),
    "paragraph": (r"\b(?:Abs\.|Absatz|al\.|alinéa|cpv\.|capoverso|para\.|paragraph)\s*(\d+)()", 0.8),
    "section": (r"§\s*(\d+[a-z]?)()", 0.8),
    "number": (r"\b(?:Ziff\.|Ziffer|ch\.|chiffre|cifra)\s*(\d+)()", 0.8),
    "letter": (r"\b(?:lit\.|Bst\.|let\.|lett\.)\s*([a-z])\b()", 0.8),
    "sr": (r"\b(?:SR|RS)\s*(\d{1,3}(?:\.\d+)*)()", 0.95),
    "publication": (r"\b(AS|RO|RU|BBl|FF)\s+(\d{4}(?:\s+[IVX]+)?\s+\d+)", 0.85),
}

_END, _STOP = r"(?:\.|;)", r"(?:,|\.|;)"
_OPEN, _CLOSE = r"(?:^|\s)", r"(?:[\s,.;]|$)"
# Words that open parts of a rule, by language; a number with its unit of time.
RULE_KINDS = {
    "CONDITION": {
        "de": rf"{_OPEN}(?:wenn|falls|sofern|vorausgesetzt|im Falle|für den Fall|unter der Bedingung|bei|nach|vor|während)\s+(.+?){_STOP}",
        "fr": rf"{_OPEN}(?:si|lorsque|quand|à condition que|dans le cas où|lors de|après|avant|pendant)\s+(.+?){_STOP}",
        "it": rf"{_OPEN}(?:se|quando|qualora|a condizione che|nel caso|durante|dopo|prima|mentre)\s+(.+?){_STOP}",
    },
    "CONSEQUENCE": {
        "de": rf"{_OPEN}(?:dann|so|gilt|beträgt|muss|darf|hat Anspruch|ist verpflichtet)\s+(.+?){_END}",
        "fr": rf"{_OPEN}(?:alors|ainsi|s'applique|est de|doit|peut|a droit|est obligé)\s+(.+?){_END}",
        "it": rf"{_OPEN}(?:allora|quindi|si applica|è di|deve|può|ha diritto|è obbligato)\s+(.+?){_END}",
    },
    "EXCEPTION": {
        "de": rf"{_OPEN}(?:ausser|ausgenommen|es sei denn|sofern nicht|mit Ausnahme|vorbehaltlich|unbeschadet)\s+(.+?){_END}",
        "fr": rf"{_OPEN}(?:sauf|excepté|à moins que|hormis|à l'exception|sous réserve|sans préjudice)\s+(.+?){_END}",
        "it": rf"{_OPEN}(?:salvo|eccetto|a meno che|tranne|ad eccezione|con riserva|senza pregiudizio)\s+(.+?){_END}",
    },
    "TEMPORAL": {"de": rf"(\d+\s*(?:Tag|Woche|Monat|Jahr)(?:e|en)?){_CLOSE}", "fr": rf"(\d+\s*(?:jour|semaine|mois|an)s?){_CLOSE}", "it": rf"(\d+\s*(?:giorn|settiman|mes|ann)[oiae]){_CLOSE}"},
    "PROHIBITION": {"de": rf"{_OPEN}(darf nicht|dürfen nicht|ist untersagt|ist verboten){_CLOSE}", "fr": rf"{_OPEN}(ne doit pas|ne peut pas|est interdit){_CLOSE}", "it": rf"{_OPEN}(non deve|non può|è vietato){_CLOSE}"},
    "OBLIGATION": {"de": rf"{_OPEN}(muss|müssen|hat zu|haben zu|ist verpflichtet|sind verpflichtet){_CLOSE}", "fr": rf"{_OPEN}(doit|doivent|est obligé|sont obligés|est tenu|sont tenus){_CLOSE}", "it": rf"{_OPEN}(deve|devono|è obbligato|sono obbligati|è tenuto|sono tenuti){_CLOSE}"},
    "PERMISSION": {"de": rf"{_OPEN}(darf|dürfen|kann|können){_CLOSE}", "fr": rf"{_OPEN}(peut|peuvent){_CLOSE}", "it": rf"{_OPEN}(può|possono){_CLOSE}"},
}
ABBREVIATIONS = r"\b(Art|Abs|Ziff|lit|Bst|al|cpv|ch|let|lett|Nr|No)\."
SENTENCE = r"[^.;]+[.;]?"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _numbered(kind: str, fields: dict | None, *more: Column):
    """A function that gives a hit its kind and position."""
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("position"), *([x[f].alias(n) for n, f in fields.items()] if fields else [x.alias("text")]), *more)


def text_references(text: Column) -> Column:
    """Array of (kind, position, raw, value, second, confidence): all hits of all kinds; position counts the hits of a kind from 1."""
    found = []
    for kind, (pattern, confidence) in REFERENCE_KINDS.items():
        zipped = F.arrays_zip(_all(text, pattern, 0).alias("raw"), _all(text, pattern, 1).alias("value"), _all(text, pattern, 2).alias("second"))
        found.append(F.transform(zipped, _numbered(kind, {"raw": "raw", "value": "value", "second": "second"}, F.lit(confidence).alias("confidence"))))
    return F.concat(*found)


def sentences(text: Column) -> Column:
    """Sentences with their end mark; the dot of an abbreviation ends none."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), ABBREVIATIONS, "$1")
    return _all(flat, SENTENCE, 0)


def rule_parts(sentence: Column, lang: Column) -> Column:
    """Array of (kind, position, text): all parts of rules in a sentence of de, fr or it."""
    found = []
    for kind, patterns in RULE_KINDS.items():
        hits = F.when(F.lit(False), F.array().cast("array<string>"))
        for code, pattern in patterns.items():
            hits = hits.when(lang == code, _all(sentence, pattern, 1))
        found.append(F.transform(F.coalesce(hits, F.array().cast("array<string>")), _numbered(kind, None)))
    return F.concat(*found)


def law_number_of_uri(uri: Column) -> Column:
    """A law's number as its URI tells it: year.number, a Roman volume with its first part, or what follows a double underscore."""
    path = F.regexp_extract(uri, r"/eli/cc/(.+)$", 1)
    roman, first = F.regexp_extract(path, r"^([IVXLC]+)/", 1), F.regexp_extract(path, r"^[IVXLC]+/([^_/]+)", 1)
    year, number = F.regexp_extract(path, r"^(\d+)/", 1), F.regexp_extract(path, r"^\d+/([^/]+)", 1)
    special = F.regexp_extract(path, r"__([^/]+)", 1)
    return (
        F.when(path == "", F.lit(None))
        .when(roman != "", F.concat_ws(" ", F.lit("SR"), roman, first))
        .when(special != "", F.concat_ws(" ", F.lit("Special"), special))
        .when(year != "", F.concat(F.lit("SR "), year, F.lit("."), number))
        .otherwise(F.concat(F.lit("SR "), path))
    )


# Kinds of law by the part of the URI.
LAW_TYPES = {"/cc/": "classified compilation", "/oc/": "official compilation", "/fga/": "federal gazette", "/treaty/": "treaty"}


def law_type(uri: Column) -> Column:
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, name in LAW_TYPES.items():
        kind = kind.when(uri.contains(part), name)
    return kind.otherwise("other")
