"""File sources and sinks: linked-data JSON, law pages in several encodings, typed edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order in which they are tried; the last accepts any bytes.
ENCODINGS = ("utf-8", "windows-1252", "iso-8859-1")


def read_json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, payload) of all JSON files below a folder, each read whole."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(F.input_file_name().alias("file_path"), F.col("value").alias("payload"))


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for raw in pdf["content"]:
            for name in ENCODINGS:
                try:
                    texts.append(raw.decode(name))
                    break
                except UnicodeDecodeError:
                    continue
        yield pd.DataFrame({"path": pdf["path"], "html": texts})


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of all HTML files below a folder, decoded by the first encoding that fits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(folder)
    return files.select("path", "content").mapInPandas(_decode, "path string, html string")


def join_pages(pages: DataFrame) -> DataFrame:
    """One row per document: pages x.html, x-1.html, x-2.html in this order, with their number."""
    number = F.coalesce(F.nullif(F.regexp_extract("path", r"-(\d+)\.html$", 1), F.lit("")).cast("int"), F.lit(0))
    keyed = pages.select(F.regexp_replace("path", r"-\d+\.html$", ".html").alias("path"), F.struct(number.alias("n"), "html").alias("p"))
    whole = keyed.groupBy("path").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.select("path", F.array_join(F.transform("ps", lambda p: p["html"]), "\n").alias("html"), F.size("ps").alias("pages"))


def write_edges(edges: DataFrame, folder: str) -> None:
    """Distinct edges in one folder per type."""
    edges.dropDuplicates(["src", "dst", "type"]).write.mode("overwrite").partitionBy("type").parquet(folder)
