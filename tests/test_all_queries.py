"""Vector searches answer every stated query, not the first alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import retrieval as R
from lexloom.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["cosine_topk", "cosine_topk_per_label", "hybrid_search", "normalized_scores", "fused_results", "merge_statistics"]


@pytest.mark.parametrize("name", NAMES)
def test_every_query_is_answered(spark, name):
    one = catalogue.QUERIES[name](spark, SF)
    rows = catalogue.QUERIES[f"{name}_all"](spark, SF)
    assert {r[0] for r in rows.select("query_id").distinct().collect()} == {0, 100, 200, 300, 400}
    assert rows.where("query_id = 0").count() == one.count()


def test_block_cosines_find_the_best_of_all(spark):
    v = np.random.default_rng(1).normal(size=(300, 5))
    v[7] = 0
    e = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(300)], "id long, label int, vector array<double>").repartition(5)
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    got = R.block_cosines(e, e.where("id % 100 = 0"), 4).toPandas().sort_values(["query_id", "cos"], ascending=[True, False]).groupby("query_id").head(4)
    for q, part in got.groupby("query_id"):
        assert set(part["id"]) == set(np.argsort(-(unit @ unit[q]))[:4])


def brute_bm25(texts, words):
    import math
    import re
    from collections import Counter

    bags = {i: Counter(re.findall("[a-zà-ÿ]+", t.lower())) for i, t in texts.items() if t is not None}
    mean = sum(len(t) for t in texts.values() if t is not None) / len(bags)
    score = dict.fromkeys(bags, 0.0)
    for w in set(words):
        df = sum(w in b for b in bags.values())
        for i, b in bags.items():
            score[i] += math.log((len(bags) - df + 0.5) / (df + 0.5) + 1) * b[w] * (R.K1 + 1) / (b[w] + R.K1 * (1 - R.B + R.B * len(texts[i]) / mean))
    return {i: s for i, s in score.items() if s > 0}


def test_keyword_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["gesetz", "frist", "loi", "délai", "norme", "ärzte", "tasse"]
    texts = {i: " ".join(rng.choice(vocabulary, rng.integers(1, 30))) for i in range(700)} | {900: None, 901: "", 902: "Gesetz! " * 50}
    queries = {1: ["gesetz", "délai", "gesetz"], 2: ["tasse"], 3: ["unbekannt"], 4: []}
    ddf = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, query_id string").repartition(3)
    qdf = spark.createDataFrame(list(queries.items()), "query_id long, words array<string>")
    got = R.top_per_group(R.bm25_blocks(ddf, "doc_id", "text", qdf, 7), ["query_id"], [F.desc("bm25"), F.asc("doc_id")], 7).collect()
    for q, words in queries.items():
        want = sorted(brute_bm25(texts, words).items(), key=lambda x: (-round(x[1], 9), x[0]))[:7]
        mine = sorted((r["doc_id"], r["bm25"]) for r in got if r["query_id"] == q)
        assert np.allclose(sorted(s for _, s in mine), sorted(s for _, s in want))
    assert R.bm25_blocks(ddf, "doc_id", "text", qdf.limit(0), 7).count() == 0 and R.bm25_blocks(ddf.limit(0), "doc_id", "text", qdf, 7).count() == 0


def test_merged_scores_and_ties(spark):
    rows = [("q", "a", "vector", 0.9), ("q", "a", "hybrid", 0.8), ("q", "a", "hybrid", 0.8), ("q", "b", "ast", 1.0), ("q", "c", "unknown", 1.0), ("r", "a", "vector", None)]
    df = spark.createDataFrame(rows, "q string, u string, method string, score double")
    got = {(r["q"], r["u"]): (r["combined_score"], r["n_methods"], r["scores"]) for r in R.merge_scores(df, ["q", "u"], {"vector": 0.3, "hybrid": 0.3, "ast": 0.2}).collect()}
    assert got["q", "a"] == (0.61, 2, "hybrid=0.80,vector=0.90") and got["q", "b"] == (0.2, 1, "ast=1.00") and got["q", "c"][0] == 0


def test_patterns_find_all_hits(spark):
    from lexloom.functions.citations import law_number_of_uri, rule_parts, sentences, text_references

    text = "Art. 5 Abs. 2 OR und Art. 7-9 sowie SR 210.1; Artikel 12 des Gesetzes, AS 2000 6, Ziff. 3 lit. b, § 4."
    df = spark.createDataFrame([(text, "https://x/eli/cc/I/2_13_7", "Wenn es regnet, muss der Halter zahlen. Er darf Art. 3 anrufen; ausser er säumt."), (None, None, None)], "t string, u string, r string")
    hits = {(h["kind"], h["value"], h["second"]) for h in df.select(F.explode(text_references(F.col("t"))).alias("h")).select("h.*").collect()}
    assert {("article_paragraph", "5", "2"), ("article_range", "7", "9"), ("sr", "210.1", ""), ("article_of", "12", "Gesetzes"), ("publication", "AS", "2000 6"), ("number", "3", ""), ("letter", "b", ""), ("section", "4", "")} <= hits
    assert [r[0] for r in df.select(law_number_of_uri(F.col("u"))).collect()] == ["SR I 2", None]
    parts = df.select(F.explode(sentences(F.col("r"))).alias("s")).select("s", F.explode(rule_parts(F.col("s"), F.lit("de"))).alias("p")).select("p.*").collect()
    assert {p["kind"] for p in parts} >= {"OBLIGATION", "PERMISSION", "EXCEPTION", "CONSEQUENCE"}


def test_places_within_a_hot_group(spark):
    rows = [(0 if i % 3 else i % 7, float(i * 37 % 50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, v double, id int").repartition(6)
    got = {r["id"]: r["place"] for r in R.ranks_within(df, ["g"], [F.desc("v"), F.asc("id")], "place").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: k for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])))}
    assert got == want
    one = spark.createDataFrame([(1, 0.7, 1), (2, 0.3, 1), (2, 0.3, 2)], "g int, v double, id int")
    told = {(r["g"], r["id"]): (r["minmax"], r["zscore"], r["rank_score"]) for r in R.normalized(one, ["g"], "v", [F.desc("v"), F.asc("id")]).collect()}
    assert told == {(1, 1): (0.5, 0.7, 1.0), (2, 1): (0.5, 0.5, 1.0), (2, 2): (0.5, 0.5, 0.5)}
    assert R.normalized(one.limit(0), ["g"], "v", [F.asc("id")]).count() == 0
