"""Canonical spellings of URIs, numbers and status codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLEAN = r"^https://[a-z0-9.\-]+/\S*[^/\s]$"
_HEAD = r"^(?i)https?://([^/]+)"
#: All white space; trimming and translating it costs less than a pattern that knows it.
BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def canonical_uri(uri: Column) -> Column:
    """One spelling per URI: no outer blanks, https, lower-case host, no final slash; '' is null.

    The path keeps its case. Values without http(s) scheme are only trimmed.
    """
    trimmed = F.regexp_replace(_trim(uri), "/$", "")
    return (
        F.when(uri.rlike(_CLEAN), uri)
        .when(trimmed == "", F.lit(None))
        .when(trimmed.rlike(_HEAD), F.concat(F.lit("https://"), F.lower(F.regexp_extract(trimmed, _HEAD, 1)), F.regexp_replace(trimmed, _HEAD, "")))
        .otherwise(trimmed)
    )


def law_of_uri(uri: Column) -> Column:
    """The law's own part ``…/eli/cc/<a>/<b>`` of a canonical URI; other URIs stay whole."""
    return F.regexp_replace(uri, r"^(https://[^/]+/eli/cc/[^/]+/[^/]+)(?s:/.*)$", "$1")


def law_designation(target: Column) -> Column:
    """How a law is named: its canonical URI, ``sr:<number>`` or ``abbr:<ABBREVIATION>``; blank is null."""
    trimmed, packed = _trim(target), F.translate(target, BLANKS, "")
    return (
        F.when(trimmed.rlike(r"^(?i)https?://"), law_of_uri(canonical_uri(target)))
        .when(packed.rlike(r"^(?i)(?:SR|RS)?[0-9][0-9A-Za-z.]*$"), F.concat(F.lit("sr:"), F.regexp_replace(packed, r"^(?i)(?:SR|RS)", "")))
        .when(trimmed != "", F.concat(F.lit("abbr:"), F.upper(trimmed)))
    )


_PART = r"(?U)\s*(?:\babs\b|\bal\b|\bcpv\b|\bpara\b)[.\s].*$|\s*(?:\babs|\bal|\bcpv|\bpara)$"


def article_number(text: Column) -> Column:
    """Article number without 'Art.', blanks, letter case and paragraph part; blank is null."""
    low = F.lower(text)
    whole = F.when(low.rlike("abs|al|cpv|para"), F.regexp_replace(low, _PART, "")).otherwise(low)
    bare = F.translate(F.regexp_replace(_trim(whole), r"(?U)^art(?:\.|ikel|icle|icolo|\b)", ""), BLANKS + ".", "")
    return F.when(text.rlike("^[0-9]+[a-z]*$"), text).otherwise(F.nullif(bare, F.lit("")))


def status_digit(status: Column) -> Column:
    """The digit that ends a status in any spelling (URI, short path, number); null if there is none."""
    digit = F.regexp_extract(status, r"(\d)/?\s*$", 1)
    return F.when(digit != "", digit)
