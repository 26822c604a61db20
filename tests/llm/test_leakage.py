import random
import unicodedata

import numpy as np

from lexloom.llm import leakage as L
from lexloom.llm.leakage import fold, leaked_items, longest_passage, tiles

SYL = "ba de fi go lu me na po ri su ta ve zo kä mü hö".split()


def words(r, n):
    return ["".join(r.choice(SYL) for _ in range(r.randrange(2, 5))) for _ in range(n)]


def codes(ws):
    cache = L.WordCodes()
    return np.array([cache[w] for w in ws], np.uint64)


def test_spellings_fold_alike():
    plain = fold("Für die Gebühren der Übung gilt das Verzeichnis")
    assert fold("FUER die Gebuehren der Übung\ngilt das Verzeich-\nnis!") == plain
    assert fold(unicodedata.normalize("NFD", "² Für die Gebühren, der Übung «gilt» das Ver-\r\nzeichnis.")) == plain
    assert fold("procès-verbal") == [b"proces-verbal"] and fold("") == [] and fold(" – ") == []
    assert fold("Привет мир") == fold("привет, МИР") != []


def lcs_like(item, doc):
    """Longest item span with edits within the rate, by full dynamic programming over all starts."""
    best = 0
    n, m = len(item), len(doc)
    for i0 in range(n):
        cost = np.zeros(m + 1, int)  # may start anywhere in the document
        for i in range(i0, n):
            new = np.empty(m + 1, int)
            new[0] = cost[0] + 1
            for j in range(1, m + 1):
                new[j] = min(new[j - 1] + 1, cost[j] + 1, cost[j - 1] + (item[i] != doc[j - 1]))
            cost = new
            if cost.min() * L.EDIT_RATE <= i - i0 + 1:
                best = max(best, i - i0 + 1)
    return best


def test_tiles_are_common_and_disjoint():
    r = random.Random(1)
    for _ in range(20):
        a, b = [r.randrange(6) for _ in range(40)], [r.randrange(6) for _ in range(50)]
        ca, cb = np.array(a, np.uint64), np.array(b, np.uint64)
        found = tiles(ca, cb)
        used_a, used_b = set(), set()
        for i, j, n in found:
            assert a[i : i + n] == b[j : j + n] and n >= L.MIN_TILE
            assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))
        if found:
            longest = max(n for n in range(1, 41) for i in range(41 - n) for j in range(51 - n) if a[i : i + n] == b[j : j + n])
            assert max(n for *_, n in found) == longest


def test_passage_length_equals_dynamic_programming():
    r = random.Random(7)
    for _ in range(6):
        item = words(r, 62)
        part = item[r.randrange(5) :][: r.randrange(38, 60)]
        for _ in range(r.randrange(4)):
            k = r.randrange(len(part))
            part[k : k + 1] = r.choice([[], ["anders"], [part[k], "mehr"]])
        doc = words(r, 10) + part + words(r, 10)
        want = lcs_like([w for w in item], doc)
        got = longest_passage(codes([w.encode() for w in item]), np.ones(len(item), int), codes([w.encode() for w in doc]))
        assert (got >= L.MIN_WORDS) == (want >= L.MIN_WORDS), (got, want)


def change(r, part, n):
    part = list(part)
    for k in sorted(r.sample(range(3, len(part) - 3, 5), n), reverse=True):
        part[k : k + 1] = r.choice([[], ["anders"], [part[k], "mehr"]])
    return part


def planted(r):
    items = {i: words(r, 120) for i in range(8)}
    items[8] = words(r, 30) + items[0][40:90] + words(r, 20)  # shares a passage with item 0
    docs, want = {}, set()
    for d in range(60):
        i, n, edits = r.randrange(8), r.choice([25, 30, 45, 60, 90]), r.choice([0, 1, 2])
        a = r.randrange(120 - n)
        body = words(r, r.randrange(5, 200)) + change(r, items[i][a : a + n], edits) + words(r, r.randrange(5, 200))
        text = " ".join(body)
        style = d % 4
        if style == 1:
            text = text.upper()
        elif style == 2:
            text = text.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace(" ", ", ", 20)
        elif style == 3:
            out = []
            for k, w in enumerate(text.split()):
                out.append(w[:2] + "-\n" + w[2:] if k % 9 == 4 and len(w) > 4 else w)
            text = "\n¹ ".join([" ".join(out[:30]), " ".join(out[30:])])
        docs[d] = text
    coded = {j: codes(fold(" ".join(v))) for j, v in items.items()}
    for d, text in docs.items():  # every pair, without seeds
        mine = codes(fold(text))
        want |= {(d, j) for j, c in coded.items() if longest_passage(c, np.ones(len(c), int), mine) >= L.MIN_WORDS}
    return items, docs, want


def test_planted_passages_equal_brute_force(spark):
    items, docs, want = planted(random.Random(3))
    assert len(want) > 20
    ddf = spark.createDataFrame([(k, v, "x", 1) for k, v in docs.items()] + [(900, None, "x", 1), (901, "", "x", 1), (902, "kurz", "x", 1)], "doc_id long, text string, words string, item_id int")
    idf = spark.createDataFrame([(k, " ".join(v), 5) for k, v in items.items()] + [(50, None, 5), (51, "", 5), (0, " ".join(items[0]), 5)], "item_id long, text string, doc_id int")
    got = [tuple(x) for x in leaked_items(ddf, idf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_without_broadcast_and_empty_tables(spark, monkeypatch):
    items, docs, want = planted(random.Random(3))
    ddf = spark.createDataFrame(list(docs.items())[:20], "doc_id long, text string")
    idf = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    monkeypatch.setattr(L, "MAX_BROADCAST_SEEDS", 0)
    monkeypatch.setattr(L, "MAX_BROADCAST_CELLS", 0)
    assert {tuple(x) for x in leaked_items(ddf, idf).collect()} == {x for x in want if x[0] < 20}
    assert leaked_items(ddf.limit(0), idf).count() == 0 and leaked_items(ddf, idf.limit(0)).count() == 0


def test_very_long_document_and_reordered_halves(spark):
    r = random.Random(11)
    item = words(r, 120)
    long = " ".join(words(r, 60_000) + item[10:60] + words(r, 10))
    halves = " ".join(words(r, 9) + item[60:105] + words(r, 9) + item[5:50] + words(r, 9))
    ddf = spark.createDataFrame([(1, long), (2, halves), (3, " ".join(item[:30] + words(r, 50) + item[30:60]))], "doc_id long, text string")
    idf = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {tuple(x) for x in leaked_items(ddf, idf).collect()} == {(1, 7), (2, 7)}


def test_reordered_passages_are_covered(spark):
    """Items cut into shuffled blocks of 12 words: none reads on for 40 words, yet the tiles cover them."""
    r = random.Random(5)
    items = {i: words(r, 60) for i in range(40)}
    docs = {}
    for i, item in items.items():
        blocks = [item[k : k + 12] for k in range(0, 60, 12)]
        order = [2, 4, 1, 3, 0] if i % 2 else [3, 0, 2, 4, 1]
        gap = lambda: words(r, 30) if i % 3 == 0 else []
        docs[i] = words(r, 40) + [w for k in order for w in blocks[k] + gap()] + words(r, 40)
    docs[100] = words(r, 300) + items[0][:24] + words(r, 50)  # little of an item
    ddf = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    idf = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in L.covered_items(ddf, idf).collect()}
    assert set(got) <= {(i, i) for i in items} and len(got) >= 0.9 * len(items)
    assert all(x["passage_words"] < L.MIN_WORDS and x["coverage"] > 0.9 for x in got.values())
    assert leaked_items(ddf, idf).count() == 0


def test_bound_follows_the_items_own_words():
    assert L.least_tokens(np.ones(60, int)) == 40 and L.least_tokens(np.full(60, 2)) == 20 and L.least_tokens(np.ones(39, int)) == 40
    r = random.Random(9)
    item = [f"{a}-{b}".encode() for a, b in zip(words(r, 20), words(r, 20))]
    w = np.array([2] * 20)
    assert longest_passage(codes(item), w, codes(item)) == 40 and L._dense(codes(item).view(np.int64), w, codes(item).view(np.int64), 0, 0)
