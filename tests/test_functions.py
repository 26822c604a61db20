from pyspark.sql import functions as F

from lexloom.functions import questions as Q
from lexloom.functions.sr import is_valid_sr, normalize_sr, sr_levels
from lexloom.functions.text import detect_language, keywords, numbered_paragraphs, occurrences, sortable_number, truncate_words, word_count
from lexloom.functions.uris import article_number, canonical_uri, law_designation, law_of_uri, status_digit


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_uris(spark):
    base = "https://lex.data.example/eli/cc/XX/1_2_3"
    spelled = [base, f" {base}/ ", base.replace("https", "http"), "HTTP://LEX.data.Example/eli/cc/XX/1_2_3/", f" {base}\t"]
    assert apply(spark, canonical_uri, spelled) == [base] * 5
    assert apply(spark, canonical_uri, [None, "", "  ", "SR 101", "https://a.example/Path/B"]) == [None, None, None, "SR 101", "https://a.example/Path/B"]
    assert apply(spark, law_of_uri, [f"{base}/20200101/de/html", f"{base}", "https://x.example/eli/oc/1/2/3", None]) == [base, base, "https://x.example/eli/oc/1/2/3", None]
    assert apply(spark, law_designation, ["SR 101.1", "RS101.1", " 101.1 ", "SR  101.1", "zrg ", f"{base}/20200101", "", None]) == ["sr:101.1"] * 4 + ["abbr:ZRG", base, None, None]


def test_article_numbers(spark):
    texts = ["Art. 12a Abs. 2", "art. 12A al. 4", "12 a cpv. 1", "12a para. 3", "ART.12A", "12a", "1bis", "art. 299 al. 3", "", None, "Art. "]
    assert apply(spark, article_number, texts) == ["12a"] * 6 + ["1bis", "299", None, None, None]


def test_status(spark):
    assert apply(spark, status_digit, ["https://x/3", "/2/", "1", "x", None, ""]) == ["3", "2", "1", None, None, None]


def test_sr(spark):
    assert apply(spark, normalize_sr, ["SR 0101.01", "RS 235.1", " 7 ", "", None]) == ["101.1", "235.1", "7", None, None]
    assert apply(spark, is_valid_sr, ["101", "0.101.1", "abc", None]) == [True, True, False, False]
    levels = apply(spark, sr_levels, ["741.01", "7", None])
    assert [x["level_uri"] for x in levels[0]] == ["sr://domain/7", "sr://domain/7/book/74", "sr://domain/7/book/74/chapter/741", "sr://domain/7/book/74/chapter/741/section/01"]
    assert [x["level"] for x in levels[1]] == ["domain"]


def test_text(spark):
    assert apply(spark, detect_language, ["der Hund und die Katze", "le chien et la table avec", "the dog and the cat", "xyz", None]) == ["de", "fr", "en", "de", "de"]
    assert apply(spark, lambda c: keywords(c, "de"), ["Die Prüfung der prüfung ab"])[0] == ["prüfung", "Prüfung"]
    assert apply(spark, word_count, ["a  b\nc", "", "  ", None, "x"]) == [3, 0, 0, 0, 1]
    assert apply(spark, lambda c: truncate_words(c, 7), ["abc def ghi", "abc", None]) == ["abc...", "abc", None]
    assert apply(spark, lambda c: occurrences(c, F.lit("aa")), ["aaaa", "b", "aaa"]) == [2, 0, 1]
    rows = apply(spark, numbered_paragraphs, ["¹ Eins.\n² Zwei.", "ohne Nummer"])
    assert [(r["number"], r["text"]) for r in rows[0]] == [("1", "Eins."), ("2", "Zwei.")] and rows[1][0]["text"] == "ohne Nummer"


def test_questions(spark):
    asked = ["What is the difference between the Civil Code and article 5?", "How to apply for citizenship?", "hello", "When was the law changed since 1990?"]
    assert [r["intent"] for r in apply(spark, lambda c: Q.intent(Q.intent_scores(c)), asked)] == ["comparative", "procedural", "exploratory", "temporal"]
    assert apply(spark, lambda c: Q.intent(Q.intent_scores(c)), ["hello"])[0]["confidence"] == 0.5
    assert apply(spark, lambda c: Q.missing_context(c, F.size(Q.entities(c)['dates']), F.size(Q.entities(c)['laws'])), asked)[1] == ["specific_type"]
    assert apply(spark, Q.ambiguity, ["maybe some of it or any"])[0] > apply(spark, Q.ambiguity, ["article 5"])[0] == 0.0
    found = apply(spark, Q.entities, ["Article 12a and art. 3 of 2004"])[0]
    assert list(found["articles"]) == ["12a", "3"] and list(found["dates"]) == ["2004"]


def test_sortable_number(spark):
    got = apply(spark, sortable_number, ["1", "12a", "Art. 5bis", "art 1000", "IV", "xxx", " 7 ", "Anhang", "", None])
    assert got == ["001", "012a", "005bis", "1000", "004", "030", "007", "anhang", "", None]
