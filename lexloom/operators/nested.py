"""Deeply nested semi-structured records as related flat tables.

Every node of a JSON record gets a Dewey label: the ordinals on the way to it. Parents are labels
cut short, and nodes with one schema path form one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "record_id {id}, label string, path string, name string, kind string, text string, anchor int, section string, entry string"


def _reject(constant: str):
    raise ValueError(constant)


def parse_strict(payload: str | None):
    """The value of a JSON text with numbers as written, or ValueError; NaN and the like are no JSON."""
    if payload is None:
        raise ValueError("null")
    return json.loads(payload, parse_constant=_reject, parse_int=_Number, parse_float=_Number)


class _Number(str):
    """A number's text."""

    __slots__ = ()


def _scalar(value) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _has_uri(value) -> bool:
    return isinstance(value, dict) and isinstance(value.get("uri"), str) and not isinstance(value["uri"], _Number) and value["uri"] != ""


def dewey_nodes(document, paths: bool = True) -> Iterator[tuple]:
    """(label, path, name, kind, text, anchor, section, entry) of the nodes of one parsed record.

    ``label`` joins the ordinals with dots, ``path`` the keys with slashes ('[]' for list members).
    ``kind`` is object, array or value. ``anchor`` is the length of the label of the nearest
    enclosing object with a ``uri`` (-1: none), ``section`` and ``entry`` are the two keys below it.
    The text of an object is its uri. Without recursion, so depth is bounded by the parser only.
    A member ``facets`` beside ``data`` hangs below ``data``. Paths are empty unless asked for.
    """
    stack = [("0", "", "", document, -1, None, None, True)]
    while stack:
        label, path, name, value, anchor, section, entry, is_doc = stack.pop()
        if isinstance(value, dict):
            subject = _has_uri(value) and not (is_doc and isinstance(value.get("data"), dict))
            yield label, path, name, "object", value["uri"] if subject else None, anchor, section, entry
            members = list(value.items())
            if is_doc and isinstance(value.get("data"), dict):
                facets = value.get("facets")
                members = [(k, {**v, "facets": facets} if k == "data" and facets is not None and "facets" not in v else v) for k, v in members if k != "facets" or "facets" in value["data"]]
            for i, (k, v) in enumerate(members):
                if subject:
                    stack.append((f"{label}.{i}", f"{path}/{k}" if paths else "", k, v, len(label), k, None, False))
                else:
                    inner = entry if entry is not None else (k if section is not None else None)
                    stack.append((f"{label}.{i}", f"{path}/{k}" if paths else "", k, v, anchor, section, inner, False))
        elif isinstance(value, list):
            yield label, path, name, "array", None, anchor, section, entry
            for i, v in enumerate(value):
                stack.append((f"{label}.{i}", f"{path}[]" if paths else "", name, v, anchor, section, entry, is_doc))
        else:
            yield label, path, name, "value", None if value is None else _scalar(value), anchor, section, entry


def shred(df: DataFrame, record_id: str, payload: str) -> DataFrame:
    """One row per node of every record whose payload is valid JSON; see :func:`dewey_nodes`.

    Null, empty, blank or cut-off payloads give no nodes. Repeated records give repeated labels:
    take the latest delivery first.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for rid, text in zip(pdf["rid"], pdf["payload"], strict=True):
                try:
                    document = parse_strict(text)
                except (ValueError, RecursionError):
                    continue
                rows.extend((rid, *node) for node in dewey_nodes(document))
                if len(rows) > 20_000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    def frame(rows):
        return pd.DataFrame(rows, columns=["record_id", "label", "path", "name", "kind", "text", "anchor", "section", "entry"])

    kind = df.schema[record_id].dataType.simpleString()
    texts = df.where(F.col(payload).isNotNull() & F.col(record_id).isNotNull()).select(F.col(record_id).alias("rid"), F.col(payload).alias("payload"))
    return texts.mapInPandas(run, NODES.format(id=kind))


def parent_label(label: Column) -> Column:
    """The label of the parent; null for the root."""
    parent = F.regexp_extract(label, r"^(.*)\.[^.]*$", 1)
    return F.when(parent != "", parent)


def object_table(nodes: DataFrame) -> DataFrame:
    """Objects with their schema path as table name and the label of the object above them."""
    return nodes.where("kind = 'object'").select("record_id", "label", parent_label(F.col("label")).alias("parent_label"), F.col("path").alias("table_name"), F.col("text").alias("uri"))


def value_table(nodes: DataFrame) -> DataFrame:
    """Scalars with the label of what holds them."""
    return nodes.where("kind = 'value' and text is not null").select("record_id", "label", parent_label(F.col("label")).alias("parent_label"), F.col("path").alias("table_name"), "name", "text")


def schema_tables(nodes: DataFrame) -> DataFrame:
    """The flat tables that the records fall into: nodes by schema path, with counts."""
    return nodes.groupBy(F.col("path").alias("table_name"), "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("record_id").alias("n_records"))


def _values_of(document, sections: Sequence[str], skip: Sequence[str]) -> set[tuple]:
    """Distinct (subject_uri, section, entry, value) of one record; a label cut to the anchor's length names the subject."""
    uris, rows = {}, set()
    for label, _, name, kind, text, anchor, section, entry in dewey_nodes(document, paths=False):
        if kind == "object" and text is not None:
            uris[label] = text
        if text and anchor >= 0 and section in sections and entry is not None and entry not in skip and not (kind == "value" and name in skip):
            rows.add((uris[label[:anchor]], section, entry, text))
    return rows


def subject_values(df: DataFrame, record_id: str, payload: str, sections: Sequence[str] = ("attributes", "references", "facets"), skip: Sequence[str] = ("xml:lang",)) -> DataFrame:
    """Distinct (record_id, subject_uri, section_name, entry_name, entry_value) of records, in one walk and without a shuffle.

    A value belongs to the object whose label is its own cut to the anchor's length. An object with
    a uri is a value of the object around it and the subject of its own values. Null and '' give no
    row; nor do the names in ``skip`` or values outside the sections. ``df`` has one row per record;
    repeated records give repeated rows. Records that are no valid JSON give none.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for rid, text in zip(pdf["rid"], pdf["payload"], strict=True):
                try:
                    rows.extend((rid, *row) for row in _values_of(parse_strict(text), sections, skip))
                except (ValueError, RecursionError):
                    continue
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["record_id", "subject_uri", "section_name", "entry_name", "entry_value"]
    kind = df.schema[record_id].dataType.simpleString()
    texts = df.where(F.col(payload).isNotNull() & F.col(record_id).isNotNull()).select(F.col(record_id).alias("rid"), F.col(payload).alias("payload"))
    return texts.mapInPandas(run, f"record_id {kind}, subject_uri string, section_name string, entry_name string, entry_value string")
