"""Text functions: language, keywords, paragraphs, counts. Patterns that must know accents carry ``(?U)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell a language, in the order in which ties are resolved, and stop words.
LANGUAGE_WORDS = {
    "de": "der die das und oder nicht mit von zu bei",
    "fr": "le la les et ou ne pas avec de à",
    "it": "il la le e o non con di a da",
    "en": "the and or not with from to at in",
}
STOP_WORDS = {
    "de": "der die das und oder in von zu mit ist ein eine",
    "fr": "le la les et ou dans de à avec est un une",
    "it": "il la le e o in di a con è un una",
    "en": "the and or in of to with is a an for",
}


def detect_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def language_hits(words: Column, lang: str) -> Column:
    """How many of the lower-case words are those of a language."""
    return F.size(F.filter(words, lambda w: w.isin(LANGUAGE_WORDS[lang].split())))


def detect_language(text: Column) -> Column:
    """The language with most hits; ties go to the first of de, fr, it, en; none or null gives de."""
    words = detect_words(text)
    hits = {lang: language_hits(words, lang) for lang in LANGUAGE_WORDS}
    best = F.greatest(*hits.values())
    choice = F.when(best <= 0, "de")
    for lang, n in hits.items():
        choice = choice.when(n == best, lang)
    return F.coalesce(choice, F.lit("de"))


def keywords(text: Column, lang: str) -> Column:
    """Distinct words longer than two letters that are no stop words; capitalized words count in both spellings."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS[lang].split()])
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w)))
    return F.array_distinct(F.concat(F.transform(kept, lambda w: F.lower(w)), kept))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a substring."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def word_count(text: Column) -> Column:
    """Words between blanks; null and blank texts have none."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(text.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, " ")))


def truncate_words(text: Column, limit: int) -> Column:
    """The text, or its beginning up to the last blank before ``limit`` with three dots behind."""
    cut = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("...")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def numbered_paragraphs(text: Column) -> Column:
    """(number, text) of paragraphs that begin a line with a superscript or plain number; else the whole text as 1."""
    parts = F.split(F.regexp_replace(text, r"(?m)^\s*([¹²³⁴⁵⁶⁷⁸⁹⁰]+|\d+)\s+", "\u0001$1\u0002"), "\u0001")
    marked = F.filter(parts, lambda p: F.instr(p, "\u0002") > 0)
    number = lambda p: F.translate(F.split_part(p, F.lit("\u0002"), F.lit(1)), "¹²³⁴⁵⁶⁷⁸⁹⁰", "1234567890")
    rows = F.transform(marked, lambda p: F.struct(number(p).alias("number"), _strip(F.split_part(p, F.lit("\u0002"), F.lit(2))).alias("text")))
    whole = F.array(F.struct(F.lit("1").alias("number"), _strip(text).alias("text")))
    return F.when(F.size(marked) > 0, rows).otherwise(whole)


def _roman(n: int) -> str:
    return "x" * (n // 10) + ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"][n % 10]


#: Roman numbers of articles up to 30, lower case.
ROMANS = {n: _roman(n) for n in range(1, 31)}


def sortable_number(number: Column) -> Column:
    """An article number that sorts as text: digits padded to three, suffix kept, Roman up to XXX as digits; others stay."""
    bare = F.regexp_replace(F.lower(F.trim(number)), r"^art\.?\s*", "")
    pad = F.repeat(F.lit("0"), F.greatest(3 - F.length(F.regexp_extract(bare, r"^\d+", 0)), F.lit(0)))
    arabic = F.create_map(*[F.lit(x) for n, r in ROMANS.items() for x in (r, f"{n:03d}")])
    return F.when(bare.rlike(r"^\d"), F.concat(pad, bare)).otherwise(F.coalesce(F.try_element_at(arabic, bare), bare))
