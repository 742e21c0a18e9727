"""Matrices and vectors as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A vector: rows (i, x), or an expression of the index, which needs no join.
Vector = DataFrame | Callable[[Column], Column]


@dataclass(frozen=True)
class SparseMatrix:
    """Entries (i, j, v), 0-based; equal places add up, places without an entry are 0.

    seq, where there is such a column, is the order in which entries were given.
    """

    entries: DataFrame
    n_rows: int
    n_cols: int

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    @property
    def square(self) -> bool:
        return self.n_rows == self.n_cols

    @property
    def order(self) -> list[str]:
        return ["seq"] if "seq" in self.entries.columns else ["j", "v"]

    def with_entries(self, entries: DataFrame) -> SparseMatrix:
        return replace(self, entries=entries)

    def rows(self) -> DataFrame:
        """The row domain, also of rows without an entry."""
        return self.spark.range(self.n_rows).withColumnRenamed("id", "i")

    @staticmethod
    def of(entries: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> SparseMatrix:
        """Entries with the least dimensions that hold them, unless they are given."""
        if n_rows is None or n_cols is None:
            i, j = entries.agg(F.max("i"), F.max("j")).first()
            n_rows = n_rows if n_rows is not None else (i + 1 if i is not None else 0)
            n_cols = n_cols if n_cols is not None else (j + 1 if j is not None else 0)
        return SparseMatrix(entries, n_rows, n_cols)


def constant(value: float = 5.0) -> Callable[[Column], Column]:
    """The default vector."""
    return lambda i: F.lit(float(value))


def random_vector(spark: SparkSession, n: int, low: float, high: float, seed: int = 42) -> DataFrame:
    """Uniform values, fixed by seed and index, whatever the partitioning: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 13)
    unit = F.conv(digits, 16, 10).cast("long") / float(1 << 52)
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(low)) + unit * float(high - low)).alias("x"))


def meet(entries: DataFrame, x: Vector) -> DataFrame:
    """Entries with the vector's value at their column, as x.

    Spark broadcasts the vector if it is below spark.sql.autoBroadcastJoinThreshold and
    shuffles both sides by column otherwise, splitting columns with very many entries.
    """
    if callable(x) and not isinstance(x, DataFrame):
        return entries.withColumn("x", x(F.col("j")))
    return entries.join(x.select(F.col("i").alias("j"), "x"), "j")


def by_rows(entries: DataFrame) -> DataFrame:
    """The entries dealt out by row, so that a task sums up all of a few rows instead of some of every row.

    Spark's rebalancing makes tasks of about the advisory partition size: it puts small
    partitions together and splits those that a row with very many entries makes large.
    """
    return entries.hint("rebalance", "i")


def over_domain(products: DataFrame, n: int, key: str, values: list[str]) -> DataFrame:
    """Sums per key, 0.0 where there is none, in one exchange: the domain comes as zeros."""
    zeros = products.sparkSession.range(n).select(F.col("id").alias(key), *[F.lit(0.0).alias(v) for v in values])
    return products.select(key, *values).unionByName(zeros).groupBy(key).agg(*[F.sum(v).alias(v) for v in values])
