"""Matrices made by rule, each partition its own rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix


def stencil_2d(spark: SparkSession, side: int) -> SparseMatrix:
    """The five-point Laplacian on a side x side grid: 4 on the diagonal, -1 for each neighbour."""
    n = side * side
    i, x = F.col("i"), F.col("i") % side
    put = lambda ok, j, v: F.when(ok, F.struct(j.cast("long").alias("j"), F.lit(float(v)).alias("v")))
    row = F.array_compact(F.array(put(i >= side, i - side, -1), put(x > 0, i - 1, -1), put(F.lit(True), i, 4), put(x < side - 1, i + 1, -1), put(i < n - side, i + side, -1)))
    entries = spark.range(n).select(F.col("id").alias("i")).select("i", F.explode(row).alias("e")).select("i", "e.j", "e.v")
    return SparseMatrix(entries, n, n)


def band(spark: SparkSession, n: int, lower: int, upper: int) -> SparseMatrix:
    """A full band; the value is 1 / (1 + distance from the diagonal)."""
    offsets = F.sequence(F.greatest(F.lit(-lower).cast("long"), -F.col("i")), F.least(F.lit(upper).cast("long"), F.lit(n - 1) - F.col("i")))
    entries = spark.range(n).select(F.col("id").alias("i")).select("i", F.explode(offsets).alias("o"))
    return SparseMatrix(entries.select("i", (F.col("i") + F.col("o")).alias("j"), (1.0 / (1.0 + F.abs("o"))).alias("v")), n, n)


def random_matrix(spark: SparkSession, n: int, per_row: int, seed: int = 42) -> SparseMatrix:
    """per_row entries in each row, fixed by seed, row and number, whatever the partitioning; places may repeat."""
    each = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("k"))
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "i", "k"), F.lit(1 << 53))
    return SparseMatrix(each.select("i", F.pmod(unit(1), F.lit(n)).alias("j"), (unit(2) / float(1 << 53) * 2 - 1).alias("v")), n, n)
