"""Figures and comparison reports, appended to a folder, and read out of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_figures(figures: DataFrame, path: str) -> None:
    figures.write.mode("append").json(path)


def append_comparison(compared: DataFrame, path: str) -> None:
    compared.write.mode("append").parquet(path)


def scrape(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(file, figure): numbers that follow a label in text files."""
    found = F.regexp_extract("value", rf"\Q{label}\E[^0-9+-]*([+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)", 1)
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.nullif(found, F.lit("")).alias("f")).where("f is not null").select("file", F.col("f").cast("double").alias("figure"))
