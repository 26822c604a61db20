import re
import time

import numpy as np
import pandas as pd
import pytest

from lexloom.llm import residue as R

ACT = "Die Prüfstelle Wenkolsigau erstattet der Halter 3063 Franken, sobald die Unterlagen unter Auflagen nach Beschluss 8622 von Dovtipluberg gemeldet sind. Für den Einsatzplan gilt Artikel 3873 des Reglements von Duquentidorf sinngemäss."
YES = [
    f"{ACT} Die Frist beträgt {{{{frist}}}} Monate.", f"{ACT} ${{law.titel}}", f"{ACT} <%= art.datum %> {ACT}", f"{ACT} %(name)s gilt.", f"@@TITEL@@ {ACT}", f"#SR_NUMMER# {ACT}", f"{ACT} der [●] Sar", f"Art. undefined {ACT}", f"Titel: null\n{ACT}",
    f"{ACT} __________ (Titel noch offen) {ACT}", f"{ACT} [Name hier eintragen]", f"<insérer Date> {ACT}", f"{ACT} XX.XX.20XX", f"TT.MM.JJJJ {ACT}", f"{ACT} [object Object] x", f"{ACT} NaN {ACT}", f"{ACT} {{0}} gilt",
    f"{ACT}\n\nNoch ein Satz Fülltext, damit der Absatz länger wird.", f"{ACT}\n\nLoremus ipsuma dolorum ametis sagitum pellenta massaus.", "xxx " * 40, f"{ACT}\n\n" + "asdf jklö " * 12, "Text folgt.",
    "Startseite · Hilfe\n\nSeite nicht gefunden (404)\n\n© 2019 Kontakt", "HTTP Status 500 – Accès refusé – Veuillez réessayer plus tard.", "Gesetz der Korporation Tortordorf\nBitte aktivieren Sie JavaScript in Ihrem Browser, um das Dokument anzuzeigen.",
    "TROPPE RICHIESTE.\nERR_CONNECTION_RESET\nVERIFICARE L'INDIRIZZO INSERITO.", "Your browser does not execute scripts; nothing can be displayed.", "code=404; trace=2e7a1d-27\nZeitüberschreitung beim Laden des Erlasses",
]
NO = [
    ACT, "Aufgehoben.", "[Aufgehoben]", f"Die Menge {{a, b, c}} der Messpunkte wird festgelegt. {ACT}", f"{ACT} [...] {ACT}", f"{ACT}\n[SR 244.48; AS 2000 6]", "Betrifft nur den italienischen Text.", "", "  \n",
    f"{ACT} Das Dokument liegt in der gewählten Sprache nicht vor. {ACT}", f"Amtliche Seiten müssen auch ohne JavaScript lesbar sein; die Prüfstelle kontrolliert dies von Amtes wegen. {ACT}", f"Blindtext in Druckvorlagen der Kanzlei Xau ist zu entfernen. {ACT}",
    f"Die Musterformulare von Xau enthalten Platzhalter in geschweiften Klammern, die der Halter ausfüllt. {ACT}", f"Wer die Fehlermeldung nach Artikel 404 missachtet, schuldet der Anstalt 3248 Franken. {ACT}",
]


@pytest.fixture(scope="module")
def docs():
    import xxhash

    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").dropna(subset="text").reset_index(drop=True)
    docs = docs.assign(key=docs["doc_id"], host=docs["source"].fillna("").map(lambda x: xxhash.xxh32_intdigest(x) % 10))
    return docs.assign(read=[any(R.readings(t)) for t in docs["text"]])


def label(docs):
    return pd.concat(R._labelled(iter([docs])), ignore_index=True)


@pytest.fixture(scope="module")
def rows(docs):
    return label(docs)


@pytest.fixture(scope="module")
def model(rows):
    return R.fit(rows)


def found(model, texts):
    return model.finds(list(texts), R.Vocabulary())


@pytest.mark.parametrize("text", YES)
def test_labels_read_residue(text):
    assert any(R.readings(text))


@pytest.mark.parametrize("text", NO)
def test_labels_read_no_true_text(text):
    assert not any(R.readings(text))


def test_scores_decide(model):
    assert found(model, YES).mean() >= 0.9 and found(model, NO).sum() <= 1
    assert not found(model, ["", " \n", None]).any()


def test_wordings_that_no_label_names_come_out(model):
    unlisted = [
        "You need to enable JavaScript to run this app.", "503 Service Unavailable. The server cannot handle the request.", "Forbidden. You don't have permission to access this resource.", "Just a moment... Checking your browser before accessing the site.",
        "Dear [Recipient Name], we refer to your letter.", "Sehr geehrte/r <Name>, wir danken für Ihr Schreiben.", "Diese Seite kann ohne JavaScript nicht angezeigt werden.",
    ]
    assert sum(any(R.readings(t)) for t in unlisted) <= 1  # a status is a label too
    assert found(model, unlisted).all()


def test_withheld_wordings_and_unseen_hosts(monkeypatch, docs, rows):
    """Every fourth wording is withheld from labels and seeds, in turn; the documents that then no label knows come out."""
    read, lost_all, found_all = docs["read"].to_numpy(), 0, 0
    named = docs["key"].isin(rows["key"][rows["kind"] != R.PLAIN]) | read  # without a wording the labels stay
    for k in range(4):
        filler, notices = ([p for i, p in enumerate(x) if i % 4 != k] for x in (R.FILLER, R.NOTICES))
        with monkeypatch.context() as m:
            m.setattr(R, "FILLER", filler)
            m.setattr(R, "NOTICES", notices)
            m.setattr(R, "_FILLER", [f" {R._plain(p)} " for p in filler])
            m.setattr(R, "_NOTICE", re.compile(rf"(?<!\S)(?:{R._any(notices)}|{R._SCRIPT}|{R._CODES})(?!\S)"))
            lost = read & ~np.array([read[i] and any(R.readings(t)) for i, t in enumerate(docs["text"])])
            again = R.fit(pd.concat([rows[~rows["key"].isin(docs["key"][named])], label(docs[named])], ignore_index=True))
            hit = found(again, docs["text"])
        assert (hit & ~read).sum() <= 0.02 * read.sum() and (hit & read).sum() >= 0.97 * read.sum()
        lost_all, found_all = lost_all + lost.sum(), found_all + (hit & lost).sum()
    assert lost_all > 20 and found_all >= 0.9 * lost_all


def test_features_number_segments_and_documents():
    texts = ["Ein Satz. Noch einer!\n\nZeile", "", None, "{{x}}", "Wort " * 35]
    seg, feats, doc, length = R._featurize(texts, R.Vocabulary())
    assert list(doc) == sorted(doc) and set(doc) == {0, 3, 4} and (feats < R.BUCKETS).all() and (feats >= 0).all()
    assert set(seg) == set(range(len(doc))) and list(length[doc == 4]) == [10, 10, 10, 5]
    for t in texts:
        if t:
            assert len(R.weak_labels(t)[0]) == R._featurize([t], R.Vocabulary())[0][-1] + 1
    assert len(R._featurize([], R.Vocabulary())[0]) == len(R._featurize([None, ""], R.Vocabulary())[0]) == 0


def test_threshold_separates_best():
    scores, labels = np.array([5.0, 4, 3, 2, 1, 0, 0]), np.array([1, 1, 1, 1, 1, 0, 0], bool)
    assert R.choose(scores, labels) == 0.5 and R.choose(scores, labels & (scores > 3)) == R.DEFAULT


def test_classifier_holds_on_unseen_hosts(spark, docs):
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = R.train(corpus)
    assert model.figures["precision"] >= 0.95 and model.figures["recall"] >= 0.9 and model.figures["test_labelled_documents"] > 20
    got, read = {r[0] for r in R.residue(corpus, model).collect()}, set(docs["doc_id"][docs["read"]])
    assert len(got & read) >= 0.97 * len(read) and len(got - read) <= 0.02 * len(read)


def test_small_tables_and_odd_rows(spark, model):
    schema = "doc_id int, text string, source string, key int, host string, label string"
    rows = [(i, t, None, 1, "h", "l") for i, t in enumerate([*YES, *NO, None, ACT * 2000 + " {{frist}}"])]
    df = spark.createDataFrame(rows + rows[:3], schema)
    got = sorted(r[0] for r in R.residue(df, model).collect())
    want = found(model, [t for _, t, *_ in rows])
    assert sorted(set(got)) == [i for i, x in enumerate(want) if x] and len(got) == want.sum() + want[:3].sum() and want[-1]
    assert R.residue(df.limit(0)).count() == 0
    assert {r[0] for r in R.residue(df).collect()} <= set(range(len(rows)))  # a model of so few rows still answers


LONG = [
    f"{ACT} {{% for artikel in gesetz.artikel_liste_sortiert if artikel.gueltig and artikel.sprache == 'de' %}}", f"{ACT} {{{{ gesetz.titel | default('Titel des Gesetzes wird von der Redaktion nachgetragen', {{}}) }}}}",
    f"{ACT} <%= gesetz.titel_in_der_gewaehlten_sprache_oder_deutsch(artikel, absatz, ziffer) %>", f"{ACT} [Bezeichnung der zuständigen kantonalen Stelle und ihrer Adresse hier eintragen]", f"{ACT} [bitte Bezeichnung der zuständigen kantonalen Stelle ergänzen]",
    "HTTP Status 500. " + "Zugriff verweigert. " * 400, "Interner Serverfehler\n" + "  at org.lex.render.Page.draw(Page.java:12)\n" * 200, "Seite nicht gefunden\n" + " | ".join(f"Rubrik{c} Tal" for c in "abcdefghijklmnopq" * 20),
]


@pytest.mark.parametrize("text", LONG)
def test_labels_read_long_slots_and_notices(text):
    assert any(R.readings(text))


def test_long_true_text_is_not():
    assert not any(R.readings(f"{ACT} {{a, b, c}} " * 200 + "Seite nicht gefunden")) and not any(R.readings(f"{ACT} [Fassung gemäss Beschluss vom 3. Mai. Die übrigen Bestimmungen lauten wie folgt] {ACT}"))


@pytest.mark.parametrize("part", ["{{", "<<", "[", "[bitte ", "[insert ", "insert ", "____ (a ", "{% "])
def test_long_texts_are_read_in_linear_time(part):
    began = time.process_time()
    R.readings("[" + part * 30_000)
    assert time.process_time() - began < 5


def test_long_notices_and_slots_come_out_by_score(model):
    assert found(model, ["HTTP Status 500. " + "Zugriff verweigert. " * 400, f"{ACT * 300} {{{{ gesetz.titel_in_der_gewaehlten_sprache_oder_deutsch_und_noch_viel_laenger_als_sechzig_zeichen }}}} {ACT * 300}"]).all()


def test_repeated_word_below_a_heading_is_filler():
    assert R.readings("Merkblatt der Anstalt Tramar\n" + "test Test " * 20)[0]
