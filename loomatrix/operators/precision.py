"""Adaptive precision: entries are split by size, small ones are stored in fewer bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_half, to_single
from ..plans.matrix import SparseMatrix, Vector, meet, over_domain

BUCKETS = {"ap[dp_sp]": ("dp", "sp"), "ap[dp_hp]": ("dp", "hp"), "ap[sp_hp]": ("sp", "hp"), "ap[dp_sp_hp]": ("dp", "sp", "hp")}
STORED = {"dp": lambda c: c.cast("double"), "sp": to_single, "hp": to_half}


def label(v: Column, mode: str, t1: Column | float, t2: Column | float | None = None) -> Column:
    """The bucket of an entry: abs(v) >= t1 is the highest precision, then >= t2, else the lowest."""
    names = BUCKETS[mode]
    size = F.abs(v)
    if len(names) == 2:
        return F.when(size >= t1, names[0]).otherwise(names[1])
    return F.when(size >= t1, names[0]).when(size >= t2, names[1]).otherwise(names[2])


def partition_precisions(a: SparseMatrix, mode: str, t1: float, t2: float | None = None, row_max: DataFrame | None = None, col_max: DataFrame | None = None) -> DataFrame:
    """The entries with their bucket in `prec`; each entry has exactly one.

    For a matrix that was equilibrated, row_max (i, m) and col_max (j, m) give the
    factors it was divided by; the thresholds are divided by them too.
    """
    if len(BUCKETS[mode]) == 3 and (t2 is None or t2 > t1):
        raise ValueError("three buckets need t2 <= t1")
    if row_max is None:
        return a.entries.withColumn("prec", label(F.col("v"), mode, F.lit(t1), None if t2 is None else F.lit(t2)))
    both = a.entries.join(row_max.select("i", F.col("m").alias("__r")), "i").join(col_max.select("j", F.col("m").alias("__c")), "j")
    scale = F.col("__r") * F.col("__c")
    at = lambda t: None if t is None else F.coalesce(F.try_divide(F.lit(t), scale), F.lit(t))
    return both.withColumn("prec", label(F.col("v"), mode, at(t1), at(t2))).select(*a.entries.columns, "prec")


def bucket_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("prec").agg(F.count("*").alias("nnz"))


def spmv_adaptive(a: SparseMatrix, split: DataFrame, x: Vector, mode: str, x_precision: str = "highest") -> DataFrame:
    """(i, y, and y_<bucket> for each bucket): every bucket's entries in its own precision.

    x_precision "highest" multiplies all buckets by x in the mode's highest precision,
    "own" each by x in its own. All buckets are summed in one pass and one exchange.
    """
    names = BUCKETS[mode]
    term = lambda name: STORED[name](F.col("v")) * STORED[names[0] if x_precision == "highest" else name](F.col("x"))
    products = meet(split, x).select("i", *[F.when(F.col("prec") == name, term(name)).otherwise(0.0).alias(f"y_{name}") for name in names])
    summed = over_domain(products, a.n_rows, "i", [f"y_{name}" for name in names])
    total = sum((F.col(f"y_{name}") for name in names[1:]), F.col(f"y_{names[0]}"))
    return summed.select("i", (to_single(total) if names[0] == "sp" else total).alias("y"), *[f"y_{name}" for name in names])
