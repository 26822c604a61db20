import json

import duckdb
import pytest

from lexloom.operators.nested import _has_uri, object_table, parent_label, shred, subject_values, value_table

SECTIONS = ("attributes", "references")


def brute(text):
    """Plain recursion over one payload: the rows of its subjects."""
    rows = set()

    def say(v):
        return "true" if v is True else "false" if v is False else str(v)

    def values(v, subject, section, entry):
        if isinstance(v, dict):
            if _has_uri(v):
                rows.add((subject, section, entry, v["uri"]))
                subject_of(v)
            else:
                for k, x in v.items():
                    if k != "xml:lang" or isinstance(x, (dict, list)):
                        values(x, subject, section, entry)
        elif isinstance(v, list):
            for x in v:
                values(x, subject, section, entry)
        elif v is not None and v != "":
            rows.add((subject, section, entry, say(v)))

    def look(v):
        """Objects with a uri anywhere below."""
        if isinstance(v, dict):
            if _has_uri(v):
                subject_of(v)
            else:
                for x in v.values():
                    look(x)
        elif isinstance(v, list):
            for x in v:
                look(x)

    def subject_of(o, facets=None):
        for k, v in o.items():
            if k in SECTIONS or k == "facets":
                if isinstance(v, dict) and not _has_uri(v):
                    for entry, x in v.items():
                        values(x, o["uri"], k, entry)
                else:
                    look(v)
            else:
                look(v)
        if isinstance(facets, dict):
            for entry, x in facets.items():
                values(x, o["uri"], "facets", entry)

    def document(o):
        if isinstance(o, list):
            for x in o:
                document(x)
        elif isinstance(o, dict):
            if isinstance(o.get("data"), dict):
                if _has_uri(o["data"]):
                    subject_of(o["data"], o.get("facets"))
                else:
                    look(o["data"])
                for k, v in o.items():
                    if k not in ("data", "facets"):
                        look(v)
            else:
                look(o)

    document(json.loads(text, parse_int=str, parse_float=str))
    return rows


def test_given_payloads_equal_recursion(spark):
    path = "/root/testdata/sf0.001/fedlex_json.parquet"
    raw = duckdb.connect().execute(f"select distinct record_id, payload from '{path}'").fetchall()
    want = set()
    for rid, text in raw:
        try:
            want |= {(rid, *r) for r in brute(text)}
        except (ValueError, TypeError):
            continue
    df = spark.createDataFrame(raw, "record_id long, payload string")
    got = [tuple(r) for r in subject_values(df, "record_id", "payload").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


ODD = [
    '{"uri": "u1", "attributes": {"a": [1, 2.50, true, null, ""], "b": {"xsd:string": "t", "xml:lang": "de"}}, "facets": {"f": ["x", {"uri": "u2", "attributes": {"c": "d"}}]}}',
    '[{"data": {"uri": "d1", "references": {"r": {"uri": "n1", "references": {"s": [{"uri": "n2", "attributes": {"k": {"deep": {"er": "v"}}}}]}}}}, "included": [{"uri": "i1", "attributes": {"k": "w"}}, {"attributes": {"lost": 1}}], "facets": {"impacts": ["p"]}}]',
    '{"data": {"attributes": {"a": "no subject"}}, "facets": {"x": "y"}}', '{"data": {"uri": "cut', "", "  ", "null", "[]", "3", '{"uri": "", "attributes": {"a": 1}}', '{"uri": "q", "attributes": {"a": NaN}}', '{"uri": "q", "attributes": "text", "references": ["x"]}',
]


def test_odd_payloads(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ODD)] + [(99, None), (None, ODD[0])], "record_id long, payload string")
    got = {tuple(r) for r in subject_values(df, "record_id", "payload").collect()}
    want = set()
    for i in (0, 1, 2, 6, 7, 8, 9, 11):
        want |= {(i, *r) for r in brute(ODD[i])}
    assert got == want
    assert (0, "u1", "attributes", "a", "2.50") in got and (1, "d1", "facets", "impacts", "p") in got and (1, "n2", "attributes", "k", "v") in got


def test_very_long_and_deep_records(spark):
    deep = '{"uri": "top", "attributes": {"a": ' + '{"x": ' * 400 + '"end"' + "}" * 400 + "}}"
    wide = json.dumps({"uri": "w", "attributes": {f"k{i}": "v" * 50 for i in range(5000)}})
    df = spark.createDataFrame([(1, deep), (2, wide)], "record_id long, payload string")
    counts = {r["record_id"]: r["count"] for r in subject_values(df, "record_id", "payload").groupBy("record_id").count().collect()}
    assert counts == {1: 1, 2: 5000}


def test_labels_give_back_the_tree(spark):
    df = spark.createDataFrame([(1, ODD[1])], "record_id long, payload string")
    nodes = shred(df, "record_id", "payload")
    labels = {r["label"]: r["path"] for r in nodes.collect()}
    for r in nodes.select("label", "path", parent_label(nodes["label"]).alias("up")).collect():
        assert r["up"] is None or (r["up"] in labels and r["path"].startswith(labels[r["up"]]))
    uris = {r["uri"] for r in object_table(nodes).collect()}
    assert {"d1", "n1", "n2", "i1"} <= uris
    assert value_table(nodes).where("text = 'v'").head()["parent_label"] in labels


@pytest.mark.parametrize("schema", ["record_id long, payload string, label string, path int, anchor string"])
def test_empty_and_clashing_columns(spark, schema):
    assert subject_values(spark.createDataFrame([], schema), "record_id", "payload").count() == 0
    df = spark.createDataFrame([(1, ODD[0], "l", 3, "a")], schema)
    assert subject_values(df, "record_id", "payload").where("subject_uri = 'u1'").count() > 0
