"""Structural and value statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import histogram_bucket
from ..plans.matrix import SparseMatrix
from ..plans.tables import running_sum
from .sell import row_lengths

#: Highest bucket of a histogram of counts.
LAST_BUCKET = 81


def value_range(a: SparseMatrix) -> DataFrame:
    """One row: the least and largest abs(v) and the middle between them."""
    low, high = F.min(F.abs("v")), F.coalesce(F.max(F.abs("v")), F.lit(0.0))
    return a.entries.agg(low.alias("min_abs"), (low + (high - low) / 2).alias("midrange"), high.alias("max_abs"))


def line_stats(a: SparseMatrix, axis: str = "i") -> DataFrame:
    """For each row (i) or column (j) with entries: n, n_nonzero, min, max, first, last place and bandwidth.

    bandwidth is the number of diagonals between a line's outermost entries, the main
    diagonal included: 1 + the farthest on either side.
    """
    other = "j" if axis == "i" else "i"
    below, above = F.greatest(F.lit(0), F.col(axis) - F.col("first")), F.greatest(F.lit(0), F.col("last") - F.col(axis))
    lines = a.entries.groupBy(axis).agg(F.count("*").alias("n"), F.count_if(F.col("v") != 0).alias("n_nonzero"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.min(other).alias("first"), F.max(other).alias("last"))
    return lines.withColumn("bandwidth", (1 + below + above).cast("long"))


def bandwidth(a: SparseMatrix) -> DataFrame:
    """One row: the lower and upper bandwidth and the width of the band that holds all entries."""
    lower, upper = F.coalesce(F.max(F.greatest(F.lit(0), F.col("i") - F.col("j"))), F.lit(0)), F.coalesce(F.max(F.greatest(F.lit(0), F.col("j") - F.col("i"))), F.lit(0))
    return a.entries.agg(lower.cast("long").alias("lower"), upper.cast("long").alias("upper"), (1 + lower + upper).cast("long").alias("bandwidth"))


def describe(values: DataFrame, column: str) -> DataFrame:
    """One row of a count column: n, min, max, avg, population std, cv, upper median.

    The median is the element at 0-based place n div 2: distinct values with their
    multiplicities are few, so a running sum over those finds it without sorting all rows.
    """
    v = F.col(column).cast("double")
    whole = values.agg(F.count("*").alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(v).alias("avg"), F.stddev_pop(v).alias("std"))
    counted = values.groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("c"))
    top = values.agg(F.max(F.col(column).cast("long"))).first()[0] or 0
    sums = running_sum(counted, "value", F.col("c"), top + 1, "ahead").crossJoin(F.broadcast(whole.select("n")))  # whole has one row
    place = F.expr("n div 2")
    median = sums.where((F.col("ahead") <= place) & (place < F.col("ahead") + F.col("c"))).agg(F.max("value").alias("median"))
    return whole.crossJoin(F.broadcast(median)).withColumn("cv", F.try_divide(F.col("std"), F.col("avg")))


def count_histogram(values: DataFrame, column: str, last: int = LAST_BUCKET) -> DataFrame:
    """(bucket, n): 0, 1, then nine buckets for each power of ten; negative counts fail."""
    checked = F.when(F.col(column) >= 0, F.col(column)).otherwise(F.raise_error(F.lit("a count is negative")))
    return values.groupBy(histogram_bucket(checked, last).alias("bucket")).agg(F.count("*").alias("n"))


def value_histogram(a: SparseMatrix, bins: int = 50) -> DataFrame:
    """(bin, n): equal-width bins between the least and the largest value, the last one closed."""
    ends = F.broadcast(a.entries.agg(F.min("v").alias("low"), F.max("v").alias("high")))  # one row
    place = F.floor((F.col("v") - F.col("low")) * bins / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    return a.entries.crossJoin(ends).groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def infinity_norm(a: SparseMatrix) -> DataFrame:
    """One row: the largest row sum of sizes."""
    return a.entries.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("norm_inf"))


def norm_threshold(a: SparseMatrix, tolerance: float) -> DataFrame:
    """One row: the size from which entries need double precision for a relative error of tolerance."""
    return infinity_norm(a).withColumn("threshold", F.lit(tolerance) * F.col("norm_inf") / (0.5 * 2.0**-23))


def matrix_profile(a: SparseMatrix) -> DataFrame:
    """One row: dimensions, entries, density, empty rows, longest row, bandwidth."""
    rows = row_lengths(a).agg(F.sum("n").cast("long").alias("nnz"), F.count_if(F.col("n") == 0).alias("empty_rows"), F.max("n").alias("longest_row"))
    density: Column = F.try_divide(F.col("nnz").cast("double"), F.lit(float(a.n_rows) * a.n_cols))
    return rows.crossJoin(bandwidth(a)).select(F.lit(a.n_rows).cast("long").alias("n_rows"), F.lit(a.n_cols).cast("long").alias("n_cols"), "nnz", density.alias("density"), "empty_rows", "longest_row", "bandwidth")


def memory_model(n_elements: Column, n_chunks: Column, n_rows: Column, value_bytes: int = 8, index_bytes: int = 4, width: int = 1) -> list[Column]:
    """Bytes of the chunk layout's arrays, and of x and y."""
    return [(n_elements * (value_bytes + index_bytes) + (2 * n_chunks + 1) * index_bytes).cast("long").alias("matrix_bytes"), (n_rows * value_bytes * width).cast("long").alias("x_bytes"), (n_rows * value_bytes * width).cast("long").alias("y_bytes")]
