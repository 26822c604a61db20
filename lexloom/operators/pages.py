"""Articles, paragraphs and headings of law pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUPER = str.maketrans("¹²³⁴⁵⁶⁷⁸⁹⁰", "1234567890")
_VOID = {"br", "img", "hr", "meta", "link", "input"}
_REPEALED = re.compile(r"aufgehoben|abrogé|abrogato|abolì", re.IGNORECASE)
SCHEMA = "path string, article_id string, heading string, number string, paragraph_number string, text string, position int, repealed boolean"


class _Articles(HTMLParser):
    """Collects (article id, heading, paragraphs) of <article> elements; unclosed tags do no harm."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.articles: list[dict] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.articles.append({"id": dict(attrs).get("id") or "", "heading": "", "parts": []})
            self.open = []
        elif self.articles and self.open is not None and tag not in _VOID:
            self.open.append(tag)
            if tag in ("p", "dd", "dt", "td", "li") and self.articles:
                self.articles[-1]["parts"].append("")
        if tag == "br" and self.articles and self.articles[-1]["parts"]:
            self.articles[-1]["parts"][-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.open = None
        elif self.open and tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.articles or self.open is None or "script" in self.open or "style" in self.open:
            return
        last = self.articles[-1]
        if any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in self.open):
            last["heading"] += data
        elif last["parts"]:
            last["parts"][-1] += data


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, html in zip(pdf["path"], pdf["html"], strict=True):
            parser = _Articles()
            parser.feed(html or "")
            parser.close()
            for a in parser.articles:
                parts = [t for t in (" ".join(p.split()) for p in a["parts"]) if t]
                heading = " ".join(a["heading"].split())
                found = re.search(r"(?i)\bart\.?\s*(\d+\s*[a-z]*)", heading) or re.search(r"art_(\d+[a-z_]*)", a["id"])
                number = re.sub(r"[\s_]", "", found.group(1)).lower() if found else None
                repealed = any(_REPEALED.search(p) for p in parts)
                for i, text in enumerate(parts or [""], 1):
                    mark = re.match(r"^([¹²³⁴⁵⁶⁷⁸⁹⁰]+)\s*", text)
                    rows.append((path, a["id"], heading, number, mark.group(1).translate(_SUPER) if mark else None, text[mark.end() :] if mark else text, i, repealed))
        yield pd.DataFrame(rows, columns=["path", "article_id", "heading", "number", "paragraph_number", "text", "position", "repealed"])


def article_paragraphs(pages: DataFrame) -> DataFrame:
    """One row per paragraph of each article of pages (path, html).

    The number comes from the heading, else from the element's id; superscripts number the
    paragraphs. An article without text gives one row with an empty text; pages without articles
    and null pages give none. The language and law come from the path.
    """
    rows = pages.select("path", "html").mapInPandas(_parse, SCHEMA)
    lang = F.nullif(F.regexp_extract("path", r"/(de|fr|it|rm|en)/", 1), F.lit(""))
    law = F.nullif(F.regexp_extract("path", r"(/eli/cc/[^/]+/[^/]+)", 1), F.lit(""))
    digits = F.regexp_extract("number", r"^(\d+)", 1)
    padded = F.concat(F.lpad(digits, 3, "0"), F.regexp_extract("number", r"^\d+(.*)$", 1))
    return rows.withColumns({"lang": lang, "law": law, "number_normalized": F.when(F.length(digits) <= 3, padded).otherwise(F.col("number"))})
