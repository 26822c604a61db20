"""Systematic numbers: normal form, validity, domain and hierarchy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domains by first digit.
DOMAINS = {
    "1": "Staat - Volk - Behörden", "2": "Privatrecht - Zivilrechtspflege - Vollstreckung", "3": "Strafrecht - Strafrechtspflege - Strafvollzug", "4": "Schule - Wissenschaft - Kultur", "5": "Landesverteidigung",
    "6": "Finanzen", "7": "Öffentliche Werke - Energie - Verkehr", "8": "Gesundheit - Arbeit - Soziale Sicherheit", "9": "Wirtschaft - Technische Zusammenarbeit",
}
VALID = r"^\d{1,3}(\.\d{1,4}){0,4}$"


def normalize_sr(number: Column) -> Column:
    """The number without SR/RS, blanks and leading zeros of its parts; blank is null."""
    bare = F.regexp_replace(F.regexp_replace(number, r"(?U)\s+", ""), r"^(?i)(SR|RS)", "")
    return F.when(bare != "", F.regexp_replace(bare, r"(^|\.)0+(?=\d)", "$1"))


def is_valid_sr(number: Column) -> Column:
    return F.coalesce(number.rlike(VALID), F.lit(False))


def sr_domain(number: Column) -> Column:
    """Name of the domain of the first digit; null for numbers without one."""
    names = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    return F.try_element_at(names, F.substring(number, 1, 1))


def sr_levels(number: Column) -> Column:
    """(level, level_uri, parent_uri) of the domain, book, chapter and section of a number such as 741.01."""
    digits = F.split_part(number, F.lit("."), F.lit(1))
    rest = F.split_part(number, F.lit("."), F.lit(2))
    d = F.concat(F.lit("sr://domain/"), F.substring(digits, 1, 1))
    b = F.concat(d, F.lit("/book/"), F.substring(digits, 1, 2))
    c = F.concat(b, F.lit("/chapter/"), digits)
    s = F.concat(c, F.lit("/section/"), rest)
    level = lambda name, uri, parent: F.struct(F.lit(name).alias("level"), uri.alias("level_uri"), parent.alias("parent_uri"))
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(
        F.when(F.length(digits) >= 1, level("domain", d, none)), F.when(F.length(digits) >= 2, level("book", b, d)),
        F.when(F.length(digits) >= 3, level("chapter", c, b)), F.when((F.length(digits) >= 3) & (rest != ""), level("section", s, c)),
    ))
