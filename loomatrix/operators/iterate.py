"""Iterated products and timing."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SpmvConfig
from ..plans.matrix import SparseMatrix, Vector, constant
from ..plans.tables import written
from .partition import deal_parts
from .precision import BUCKETS, partition_precisions, spmv_adaptive
from .scale import dropout, equilibrate
from .sell import from_sell, spmmv_sell, spmv_sell, to_sell
from .spmv import CASTS, spmmv_rowwise, spmv


def power(a: SparseMatrix, x: Vector, times: int, cut_every: int = 4) -> DataFrame:
    """A^times x as (i, y), without normalising. The vector is written every few products."""
    if not a.square:
        raise ValueError("iterated products need a square matrix")
    for k in range(times):
        y = spmv(a, x)
        x = y.withColumnRenamed("y", "x")
        if (k + 1) % cut_every == 0 and k + 1 < times:
            x = written(x)
    if times == 0:
        return a.rows().select("i", x(F.col("i")).alias("y")) if callable(x) and not isinstance(x, DataFrame) else x.withColumnRenamed("x", "y")
    return x.withColumnRenamed("x", "y")


def _dealt(a: SparseMatrix, config: SpmvConfig) -> SparseMatrix:
    """The entries in the configured row parts."""
    if config.parts == 1 and config.segmentation == "rows":
        return a
    return deal_parts(a, config.parts, config.segmentation)


def _chunked(config: SpmvConfig) -> bool:
    return config.format == "scs" and (config.chunk > 1 or config.sigma > 1)


def _laid_out(a: SparseMatrix, config: SpmvConfig) -> SparseMatrix:
    """The entries as they come out of the configured format. Compressed rows are what a product's
    sums group by, so entries aren't packed for one; stored.store() keeps them packed for many."""
    return from_sell(to_sell(a, config.chunk, config.sigma)) if _chunked(config) else a


def execute(a: SparseMatrix, config: SpmvConfig, x: Vector | None = None) -> DataFrame:
    """One product as the configuration says: (i, y)."""
    a, x = _dealt(a, config), x if x is not None else constant()
    if config.dropout:
        a = dropout(a, config.dropout_threshold)
    rows = cols = None
    if config.equilibrate:
        a, rows, cols = equilibrate(a)
    if config.precision in BUCKETS:
        laid = _laid_out(a, config)
        split = partition_precisions(laid, config.precision, config.threshold_1, config.threshold_2, rows, cols)
        return spmv_adaptive(laid, split, x, config.precision, config.x_precision).select("i", "y")
    if _chunked(config):
        return spmv_sell(to_sell(a, config.chunk, config.sigma), x, config.precision)
    return spmv(_laid_out(a, config), x, config.precision)


def execute_block(a: SparseMatrix, config: SpmvConfig, xs: DataFrame | None = None) -> DataFrame:
    """One product with block_width vectors, X as (i, xs array), as the configuration says: (i, ys)."""
    a = _dealt(a, config)
    if config.precision in BUCKETS:
        raise ValueError("adaptive precision has no products with a block of vectors")
    if xs is None:
        # vectors that differ, so that no vector's work is folded into another's
        xs = a.spark.range(a.n_cols).select(F.col("id").alias("i"), F.array(*[((F.col("id") + k) % 7 + 1).cast("double") for k in range(config.block_width)]).alias("xs"))
    if config.dropout:
        a = dropout(a, config.dropout_threshold)
    if config.equilibrate:
        a = equilibrate(a)[0]
    if _chunked(config):
        return spmmv_sell(to_sell(a, config.chunk, config.sigma), xs, config.block_width, config.precision)
    cast = CASTS[config.precision]
    a = a.with_entries(a.entries.withColumn("v", cast(F.col("v"))))
    xs = xs.select("i", F.transform("xs", cast).alias("xs"))
    return spmmv_rowwise(_laid_out(a, config), xs, config.block_width)


def gflops(nnz: int, width: int, seconds: float) -> float:
    """Two operations for each entry and vector; padding doesn't count."""
    return 2.0 * nnz * width / seconds / 1e9


def benchmark(a: SparseMatrix, config: SpmvConfig) -> DataFrame:
    """Times products without keeping them, twice as many each round until bench_seconds are
    reached; one row of figures. With block_width above 1 each product has so many vectors."""
    product = execute_block if config.block_width > 1 else execute
    nnz = a.entries.count()
    once = lambda: product(a, config).write.format("noop").mode("overwrite").save()
    for _ in range(config.warm_ups):
        once()
    n = 1
    while True:
        n, began = n * 2, time.perf_counter()
        for _ in range(n):
            once()
        took = time.perf_counter() - began
        if took >= config.bench_seconds:
            break
    row = (config.matrix, config.format, config.precision, config.chunk, config.sigma, nnz, n, took / n, gflops(nnz, config.block_width, took / n))
    return a.spark.createDataFrame([row], "matrix string, format string, precision string, chunk int, sigma int, nnz bigint, products int, seconds double, gflops double")
