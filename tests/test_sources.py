from lexloom.operators.pages import article_paragraphs
from lexloom.sources.files import join_pages, read_json_documents, read_pages, write_edges

PAGE = """<html><body><main id="maintext"><article id="art_{n}"><h6 class="heading"><b>Art. {n}</b> Zweck</h6><div class="collapseable">
<p><sup></sup>¹ Erster Absatz.</p><p>² Zweiter <i>Absatz</i><dl><dt>a.</dt><dd>Buchstabe a</dd></dl></div></article><script>var x = "<p>no</p>";</script></main>"""


def test_articles_of_pages(spark):
    rows = [("/eli/cc/1999/404/20240101/de/html/x.html", PAGE.format(n="1bis")), ("/y/fr/z.html", '<article id="art_7"><p>Abrogé</p></article>'), ("/n.html", "<div>none</div>"), ("/0.html", None), ("/e.html", "<article id='art_335_b'></article>")]
    df = spark.createDataFrame(rows, "path string, html string")
    got = article_paragraphs(df).orderBy("path", "position").collect()
    first = [r for r in got if "404" in r["path"]]
    assert [(r["paragraph_number"], r["text"]) for r in first] == [("1", "Erster Absatz."), ("2", "Zweiter Absatz"), (None, "a."), (None, "Buchstabe a")]
    assert {(r["number"], r["number_normalized"], r["lang"], r["law"], r["repealed"]) for r in first} == {("1bis", "001bis", "de", "/eli/cc/1999/404", False)}
    other = {r["path"]: (r["number"], r["number_normalized"], r["repealed"]) for r in got if "404" not in r["path"]}
    assert other == {"/y/fr/z.html": ("7", "007", True), "/e.html": ("335b", "335b", False)}


def test_files(spark, tmp_path):
    for name, text in (("a.html", "eins"), ("a-1.html", "zwei"), ("a-10.html", "drei"), ("b.html", "grün")):
        (tmp_path / name).write_bytes(text.encode("windows-1252"))
    (tmp_path / "d.json").write_text('{"data":\n 1}')
    pages = join_pages(read_pages(spark, str(tmp_path))).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["html"], r["pages"]) for r in pages} == {("a.html", "eins\nzwei\ndrei", 3), ("b.html", "grün", 1)}
    assert [r["payload"] for r in read_json_documents(spark, str(tmp_path)).collect()] == ['{"data":\n 1}']
    edges = spark.createDataFrame([("a", "b", "X"), ("a", "b", "X"), ("b", "c", "Y")], "src string, dst string, type string")
    write_edges(edges, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).where("type = 'X'").count() == 1


def test_small_tables_are_dealt_out_whole(spark, monkeypatch):
    from lexloom import session

    df = session.table(spark, "/root/testdata/sf0.001", "law_nodes")
    out = session.dealt(df)
    assert out.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    monkeypatch.setattr(session, "SMALL_BYTES", 10)
    assert session.dealt(df) is df
