"""Scores and their fusion: cosine, BM25, path scores, normalization, merging."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import occurrences
from lexloom.session import materialize

K1, B = 1.2, 0.75
# Weights of edge types (lower is nearer) and of laws by number.
EDGE_WEIGHTS = {"REFERENCES": 1.0, "CITES": 1.0, "AMENDS": 1.2, "HAS_ARTICLE": 0.8, "HAS_PARAGRAPH": 0.9, "HAS_SUBPOINT": 0.95, "HAS_VERSION": 1.5, "HAS_ACT": 1.3, "REPLACES": 1.1, "REPLACED_BY": 1.1}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def bm25(docs: DataFrame, doc: str, text: str, words: Sequence[str]) -> DataFrame:
    """(doc, bm25) of the documents with any of the words, by substrings of the lower-case text.

    Length counts in characters. The texts are read once: counts and lengths are kept as numbers,
    and the statistics over them are one row, joined back by broadcast of that row.
    """
    low = docs.where(F.col(text).isNotNull()).select(doc, F.lower(text).alias("_t")).select(doc, F.length("_t").alias("_len"), *[occurrences(F.col("_t"), F.lit(w)).alias(f"_tf{i}") for i, w in enumerate(words)])
    low = materialize(low)
    stats = low.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(words))])
    both = low.where(" or ".join(f"_tf{i} > 0" for i in range(len(words)))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        tf = F.col(f"_tf{i}")
        score += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return both.select(doc, score.alias("bm25"))


def _packed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), size):
            part = pdf.iloc[i : i + size]
            yield pd.DataFrame({"ids": [part["id"].to_list()], "labels": [part["label"].to_list()], "vectors": [np.stack([np.asarray(v, np.float64) for v in part["vector"]]).tobytes()]})


def _unit(vectors: bytes, n: int) -> np.ndarray:
    m = np.frombuffer(vectors).reshape(n, -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def _block_scores(batches: Iterator[pd.DataFrame], k: int | None, per_label: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for b in pdf.itertuples():
            ids, labels, queries = np.asarray(b.ids), np.asarray(b.labels), np.asarray(b.query_ids)
            cos = np.round(_unit(b.query_vectors, len(queries)) @ _unit(b.vectors, len(ids)).T, 12)
            for q, row in zip(queries, cos, strict=True):
                order = np.lexsort((ids, -row)) if k else np.arange(len(ids))
                if k and per_label:
                    order = order[np.sort(np.concatenate([np.flatnonzero(labels[order] == x)[:k] for x in np.unique(labels)]))]
                elif k:
                    order = order[:k]
                yield pd.DataFrame({"query_id": q, "id": ids[order], "label": labels[order], "cos": row[order]})


def block_cosines(rows: DataFrame, queries: DataFrame, k: int | None = None, per_label: bool = False) -> DataFrame:
    """(query_id, id, label, cos) of all rows for all queries, both (id, label, vector), by products of blocks.

    Vectors of no length have cosine 0; cosines are rounded to 12 digits, so that equal vectors tie. With ``k`` each
    pair of blocks gives only its best k of each query (and label); the best of all are among them.
    """
    kinds = "ids array<bigint>, labels array<int>, vectors binary"
    pack = lambda df, size: df.select("id", "label", "vector").mapInPandas(lambda it: _packed(it, size), kinds)
    asked = pack(queries, 256).select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    return pack(rows, 4096).crossJoin(asked).mapInPandas(lambda it: _block_scores(it, k, per_label), "query_id bigint, id bigint, label int, cos double")


def ranks_within(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, within its group: groups of any size are ordered by ranges, not in one task each.

    Ranges of group and order are cut by a sample; each range counts its own rows and starts where those of its group
    before it end. ``order`` must tell all rows of a group apart.
    """
    parts = materialize(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(starts, [*by, "_part"]).withColumn(name, F.col("_start") + F.col("_own")).drop("_own", "_start", "_part")


def normalized(scores: DataFrame, by: Sequence[str], score: str, order: Sequence[Column]) -> DataFrame:
    """``scores`` with ``minmax``, ``zscore`` and ``rank_score`` within each group.

    Extremes, mean and deviation are aggregated before they are joined back: one row a group. Min-max
    is 0.5 where all are equal; the z-score goes through a sigmoid, a single score stays, equal scores
    give 0.5; the rank score is 1 - place / n, the best at place 0.
    """
    c = F.col(score)
    told = scores.groupBy(*by).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.avg(c).alias("_mean"), F.stddev_pop(c).alias("_std"), F.count(F.lit(1)).alias("_n"))
    minmax = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    zscore = F.when(F.col("_n") < 2, c).when(F.col("_std") == 0, 0.5).otherwise(1 / (1 + F.exp(-(c - F.col("_mean")) / F.col("_std"))))
    ranked = ranks_within(scores, by, order, "_place").join(told, list(by))
    return ranked.select(*scores.columns, minmax.alias("minmax"), zscore.alias("zscore"), (1 - F.col("_place") / F.col("_n")).alias("rank_score"))


def merge_methods(results: DataFrame, weights: Mapping[str, float], bonus: float = 0.1) -> DataFrame:
    """One row per uri of (uri, method, score): weighted sum of scores, with a bonus for each further method.

    The sum is capped at 1 only if several methods found the uri. Rows of unknown methods weigh 0.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("method")), F.lit(0.0))
    one = results.groupBy("uri", "method").agg(F.max("score").alias("score"))
    merged = one.groupBy("uri").agg(F.sum(weight * F.col("score")).alias("s"), F.count(F.lit(1)).alias("n_methods"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    return merged.select("uri", F.when(F.col("n_methods") > 1, F.least(F.lit(1.0), F.col("s") + bonus * (F.col("n_methods") - 1))).otherwise(F.col("s")).alias("combined_score"), "n_methods", "methods")


def merge_scores(results: DataFrame, keys: Sequence[str], weights: Mapping[str, float], bonus: float = 0.1) -> DataFrame:
    """One row per key of (keys…, method, score), with each method's score as text; see :func:`merge_methods`."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("method")), F.lit(0.0))
    one = results.groupBy(*keys, "method").agg(F.max("score").alias("score"))
    told = F.array_join(F.array_sort(F.collect_list(F.concat("method", F.lit("="), F.format_string("%.2f", F.col("score"))))), ",")  # one a method
    merged = one.groupBy(*keys).agg(F.sum(weight * F.col("score")).alias("s"), F.count(F.lit(1)).alias("n_methods"), told.alias("scores"))
    score = F.when(F.col("n_methods") > 1, F.least(F.lit(1.0), F.col("s") + bonus * (F.col("n_methods") - 1))).otherwise(F.col("s"))
    return merged.select(*keys, F.round(score, 6).alias("combined_score"), "n_methods", "scores")


_WORD = re.compile("[a-zà-ÿ]+")
#: Pairs of a query and one of its words that are sent to the tasks at most.
MAX_QUERY_WORDS = 2_000_000


def _counts(batches: Iterator[pd.DataFrame], known: dict[str, int]) -> Iterator[pd.DataFrame]:
    """How many texts of the partition hold each word, and under -1 their number and length."""
    df, n, total = np.zeros(len(known), np.int64), 0, 0
    for pdf in batches:
        for text in pdf["text"]:
            df[[known[w] for w in set(_WORD.findall(text.lower())) if w in known]] += 1
            total += len(text)
        n += len(pdf)
    hit = np.flatnonzero(df)
    yield pd.DataFrame({"word": np.append(hit, -1), "n": np.append(df[hit], n), "total": np.append(np.zeros(len(hit), np.int64), total)})


def _word_scores(batches: Iterator[pd.DataFrame], known: dict[str, int], idf: np.ndarray, mean: float, offsets: np.ndarray, asked: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The best ``k`` texts of each slice for each query, by the queries that ask for each word (``offsets`` into ``asked``)."""
    for pdf in batches:
        for i in range(0, len(pdf), 512):
            part = pdf.iloc[i : i + 512]
            scores = np.zeros((len(ids), len(part)), np.float32 if len(ids) > 100_000 else np.float64)
            for col, text in enumerate(part["text"]):
                for word, tf in Counter(w for w in _WORD.findall(text.lower()) if w in known).items():
                    w = known[word]
                    scores[asked[offsets[w] : offsets[w + 1]], col] += idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(text) / mean))
            docs = part["id"].to_numpy()
            order = np.lexsort((np.broadcast_to(docs, scores.shape), -scores), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), order.shape[1])
            best = scores[rows, order.ravel()]
            hit = best > 0
            yield pd.DataFrame({"query_id": ids[rows[hit]], "doc_id": docs[order.ravel()[hit]], "bm25": best[hit].astype(float)})


def bm25_blocks(docs: DataFrame, doc: str, text: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, bm25): candidates among which are the best ``k`` documents of each query (query_id, words).

    Whole words of the lower-case text count, lengths are characters. The stated queries' words are
    sent to the texts, which are read twice, for the statistics and for the scores; each slice of
    512 texts gives its best ``k`` for each query, so no pair of a query and a document is shuffled
    beyond these. Raises ValueError for more than MAX_QUERY_WORDS words of queries: split them.
    """
    rows = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word")).limit(MAX_QUERY_WORDS + 1).toPandas()
    if len(rows) > MAX_QUERY_WORDS:
        raise ValueError("too many words of queries at once")
    texts = docs.where(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "query_id long, doc_id long, bm25 double"
    if rows.empty:
        return docs.sparkSession.createDataFrame([], schema)
    names, word = np.unique(rows["word"].to_numpy(str), return_inverse=True)
    ids, query = np.unique(rows["query_id"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(word, kind="stable")
    known, asked, offsets = {w: i for i, w in enumerate(names.tolist())}, query[order], np.searchsorted(word[order], np.arange(len(names) + 1))
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(known)
    counts = texts.mapInPandas(lambda it: _counts(it, table.value), "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
    if counts.empty or not counts.loc[counts["word"] < 0, "n"].sum():
        return docs.sparkSession.createDataFrame([], schema)
    head = counts[counts["word"] < 0].iloc[0]
    df = np.zeros(len(names))
    df[counts["word"][counts["word"] >= 0]] = counts["n"][counts["word"] >= 0]
    shared = sc.broadcast((np.log((head["n"] - df + 0.5) / (df + 0.5) + 1), max(head["total"] / max(head["n"], 1), 1e-9), offsets, asked, ids))
    return texts.mapInPandas(lambda it: _word_scores(it, table.value, *shared.value, k), schema)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def path_score(length: Column, types: Column, hierarchy: Column) -> Column:
    """1/(1+length) · 1/(geometric mean of the edge weights) · (2 - hierarchy weight)."""
    weights = F.create_map(*[F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair])
    logs = F.aggregate(types, F.lit(0.0), lambda s, t: s + F.log(F.coalesce(F.try_element_at(weights, t), F.lit(1.5))))
    return 1 / (1 + length) / F.exp(logs / F.size(types)) * (2 - hierarchy)
