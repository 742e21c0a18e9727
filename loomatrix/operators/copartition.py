"""Iterated products over a matrix that was dealt out once.

The entries stand in a table bucketed by column, with as many buckets as shuffles have
partitions. A vector that an aggregation put out is dealt by its index in the same way, so
each step joins in place: its only exchange is of the vector's partial sums, none is of the
matrix. Columns with more entries than a bucket's share would make one task slow; there
are fewer of them than buckets, so their entries stay spread and meet their few values of
the vector by broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix, Vector, over_domain
from ..plans.tables import new_path, written


def _table(df: DataFrame, buckets: int, column: str) -> str:
    """Writes df as a table bucketed by the column, in the shared folder."""
    name = f"loomatrix_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).sortBy(column).option("path", new_path(df.sparkSession, "buckets")).option("compression", "zstd").saveAsTable(name)
    return name


@dataclass(frozen=True)
class BucketedMatrix:
    """A square matrix: table `cold` bucketed by j, and the entries of the columns `heavy`, if any."""

    spark: SparkSession
    cold: str
    hot: DataFrame | None
    heavy: list[int]
    n_rows: int
    buckets: int

    def step(self, x: DataFrame) -> DataFrame:
        """A x of x (i, x) as (i, x), rows that no entry reaches left out."""
        value = x.select(F.col("i").alias("j"), "x")
        products = self.spark.table(self.cold).join(value.hint("shuffle_hash"), "j").select("i", (F.col("v") * F.col("x")).alias("x"))
        if self.hot is not None:
            few = value.where(F.col("j").isin(self.heavy))  # fewer than there are buckets
            products = products.unionByName(self.hot.join(F.broadcast(few), "j").select("i", (F.col("v") * F.col("x")).alias("x")))
        return products.groupBy("i").agg(F.sum("x").alias("x"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.cold}")


def bucketed(a: SparseMatrix) -> BucketedMatrix:
    """Deals the entries out by column, once, for any number of products."""
    if not a.square:
        raise ValueError("iterated products need a square matrix")
    spark = a.spark
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = written(a.entries.select("i", "j", "v"))
    share = max(1, entries.count() // buckets)
    heavy = sorted(j for j, in entries.groupBy("j").count().where(F.col("count") > share).select("j").collect())  # fewer than `buckets`
    hot = written(entries.where(F.col("j").isin(heavy))) if heavy else None
    cold = entries.where(~F.col("j").isin(heavy)) if heavy else entries
    return BucketedMatrix(spark, _table(cold.repartition(buckets, "j"), buckets, "j"), hot, heavy, a.n_rows, buckets)


def power_bucketed(m: BucketedMatrix, x: Vector, times: int, cut_every: int = 4) -> DataFrame:
    """A^times x as (i, y). Every few products the vector is written, in buckets too, which cuts
    the lineage without another exchange."""
    if callable(x) and not isinstance(x, DataFrame):
        x = m.spark.range(m.n_rows).select(F.col("id").alias("i"), x(F.col("id")).alias("x"))
    for k in range(times):
        x = m.step(x)
        if (k + 1) % cut_every == 0 and k + 1 < times:
            x = m.spark.table(_table(x, m.buckets, "i"))
    return over_domain(x.withColumnRenamed("x", "y"), m.n_rows, "i", ["y"])
