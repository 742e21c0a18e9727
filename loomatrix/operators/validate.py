"""Comparing a result with a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = 1e-2, 1e-4
TOLERANCE = {"dp": 1e-13, "sp": 1e-5, "hp": 1e-2}


def compare(result: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ("i",)) -> DataFrame:
    """(keys, y, ref, absolute, relative, verdict) for each element of either side.

    relative is |ref - y| / |ref|; where the reference is 0 it is 0 for equal values and
    infinite otherwise. A missing element, NaN or infinity is an error.
    """
    both = result.select(*keys, "y").join(reference.select(*keys, F.col("y").alias("ref")), list(keys), "full")
    absolute = F.abs(F.col("ref") - F.col("y"))
    infinite = F.lit(float("inf"))
    relative = F.when(F.col("ref") == 0, F.when(F.col("y") == 0, 0.0).otherwise(infinite)).otherwise(F.try_divide(absolute, F.abs("ref")))
    both = both.withColumn("absolute", absolute).withColumn("relative", F.coalesce(relative, infinite))
    return both.withColumn("verdict", F.when((F.col("relative") > ERROR) | F.isnan("relative"), "ERROR").when(F.col("relative") > WARNING, "WARNING").otherwise("OK"))


def summary(compared: DataFrame) -> DataFrame:
    """One row: counts of verdicts, largest differences and the first row where they are, Euclidean norms."""
    diff = F.col("ref") - F.col("y")
    return compared.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("verdict") == "ERROR").alias("errors"),
        F.count_if(F.col("verdict") == "WARNING").alias("warnings"),
        F.max("relative").alias("max_relative"),
        F.max_by("i", F.struct("relative", -F.col("i"))).alias("at_relative"),
        F.max("absolute").alias("max_absolute"),
        F.max_by("i", F.struct("absolute", -F.col("i"))).alias("at_absolute"),
        F.sqrt(F.sum(diff * diff)).alias("distance"),
        F.sqrt(F.sum(F.col("ref") * F.col("ref"))).alias("magnitude"),
    )


def mismatches(compared: DataFrame, tolerance: float) -> DataFrame:
    """One row: elements whose relative difference exceeds the tolerance, and the largest one."""
    return compared.agg(F.count_if(F.col("relative") > tolerance).alias("mismatches"), F.max("relative").alias("max_relative"))


def first_mismatches(compared: DataFrame, tolerance: float, count: int = 10) -> DataFrame:
    return compared.where(F.col("relative") > tolerance).orderBy("i").limit(count)
