"""Scaling and dropping entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix


def row_max(a: SparseMatrix) -> DataFrame:
    """(i, m): the largest abs(v) in each row that has entries."""
    return a.entries.groupBy("i").agg(F.max(F.abs("v")).alias("m"))


def col_max(a: SparseMatrix) -> DataFrame:
    return a.entries.groupBy("j").agg(F.max(F.abs("v")).alias("m"))


def _divided(v: Column, m: Column) -> Column:
    """A row or column of zeros stays as it is."""
    return F.coalesce(F.try_divide(v, F.nullif(m, F.lit(0.0))), v)


def equilibrate(a: SparseMatrix) -> tuple[SparseMatrix, DataFrame, DataFrame]:
    """Divides rows by their largest size, then columns of the result by theirs.

    Returns the scaled matrix, row_max (i, m) and col_max (j, m).
    """
    rows = row_max(a)
    scaled = a.with_entries(a.entries.join(rows.withColumnRenamed("m", "__m"), "i").withColumn("v", _divided(F.col("v"), F.col("__m"))).select(*a.entries.columns))
    cols = col_max(scaled)
    done = scaled.entries.join(cols.withColumnRenamed("m", "__m"), "j").withColumn("v", _divided(F.col("v"), F.col("__m"))).select(*a.entries.columns)
    return a.with_entries(done), rows, cols


def dropout(a: SparseMatrix, threshold: float) -> SparseMatrix:
    """Keeps entries of at least this size; the filter reaches the scan."""
    return a.with_entries(a.entries.where((F.col("v") >= threshold) | (F.col("v") <= -threshold)))


def cast_values(a: SparseMatrix, kind: str) -> SparseMatrix:
    return a.with_entries(a.entries.withColumn("v", F.col("v").cast(kind)))


def expand_symmetric(a: SparseMatrix) -> SparseMatrix:
    """Adds (j, i, v) after each off-diagonal (i, j, v)."""
    there, back = F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = a.entries.withColumn("__p", F.explode(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))))
    return a.with_entries(both.withColumn("i", F.col("__p.i")).withColumn("j", F.col("__p.j")).drop("__p"))
