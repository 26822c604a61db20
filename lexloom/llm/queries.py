"""Queries over the text corpus. None has equivalent SQL; tests compare them with brute force."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.leakage import covered_items, leaked_items
from lexloom.llm.packing import BITS, CAPACITY, DIMS, pack_texts
from lexloom.llm.residue import residue, train
from lexloom.session import dealt, materialize, table

#: Ranks of a public byte-level BPE for many languages; the path can be set in the session.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _vocabulary(spark: SparkSession) -> tuple[str, str]:
    """The vocabulary's path and the pattern that splits texts before it."""
    path = spark.conf.get("lexloom.vocabulary", VOCABULARY)
    import public_tokenizers

    return os.path.realpath(path), public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(_documents(spark, sf_dir), *_vocabulary(spark))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of room used; how far the curve keys of a container lie apart, as a share of the curve, beside random groups of as many."""
    pieces = materialize(p6_containers(spark, sf_dir))
    spread = lambda by: pieces.groupBy(by.alias("g")).agg(F.sum("n_tokens").alias("n"), F.count_distinct("doc_id").alias("k"), ((F.max("curve") - F.min("curve")) / (1 << DIMS * BITS)).alias("d"))
    filled = spread(F.col("container_id")).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.avg(F.when(F.col("k") > 1, F.col("d"))).alias("spread"))
    n = filled.head()["n_containers"]  # one number
    random = spread(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(n, 1)))).agg(F.avg(F.when(F.col("k") > 1, F.col("d"))).alias("random_spread"))
    return filled.join(random).select("n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * CAPACITY)).alias("used_share"), "spread", "random_spread")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that leaked, with the number of documents that reveal them."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items by what the tiles cover, reordered passages too."""
    return covered_items(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(_documents(spark, sf_dir, "source"))


def p8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the classifier on hosts that it was not fitted on."""
    figures = train(_documents(spark, sf_dir, "source")).figures
    return spark.createDataFrame([(k, float(v)) for k, v in figures.items()], "figure string, value double")


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p7_found, p7_items, p7_coverage, p8_found, p8_validation)}
ORACLES: dict[str, str] = {}
