"""Matrices in the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _size(df: DataFrame, key: str) -> int:
    return (df.agg(F.max(key)).first()[0] or 0) + 1


def parts_by_suppliers(spark: SparkSession, folder: str, value: str = "l_quantity", square: bool = False) -> SparseMatrix:
    """i = part, j = supplier, v = a lineitem column; equal places add up."""
    entries = read(spark, folder, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col(value).alias("v"))
    n_rows, n_cols = _size(read(spark, folder, "part"), "p_partkey"), _size(read(spark, folder, "supplier"), "s_suppkey")
    return SparseMatrix(entries, max(n_rows, n_cols) if square else n_rows, max(n_rows, n_cols) if square else n_cols)


def customers_by_parts(spark: SparkSession, folder: str) -> SparseMatrix:
    """i = customer, j = part, v = quantity, through the customer's orders."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("i"))
    n_rows, n_cols = _size(read(spark, folder, "customer"), "c_custkey"), _size(read(spark, folder, "part"), "p_partkey")
    return SparseMatrix(lines.join(orders, "l_orderkey").select("i", "j", "v"), n_rows, n_cols)
