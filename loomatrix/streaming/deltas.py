"""Products kept up to date while entries arrive: A x is linear in A, so changes add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.matrix import Vector, meet

SCHEMA = "i bigint, j bigint, v double"


def read_deltas(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of entries to add, from Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_product(deltas: DataFrame, x: Vector) -> DataFrame:
    """(i, y) of all entries so far; rows that change come out in update mode. The state has a
    row of the result for each row of the matrix seen."""
    return meet(deltas, x).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
