"""Products of a sparse matrix with a vector or a block of vectors.

All storage formats give the same product; Catalyst picks the join and the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_half, to_single
from ..plans.matrix import SparseMatrix, Vector, by_rows, meet, over_domain

CASTS = {"dp": lambda c: c.cast("double"), "sp": to_single, "hp": to_half}


def spmv(a: SparseMatrix, x: Vector, precision: str = "dp") -> DataFrame:
    """y = A x as (i, y), a row for each row of A.

    sp and hp round the entries and the vector; sums are in double for all precisions,
    which is at least as accurate.
    """
    cast = CASTS[precision]
    products = meet(a.entries, x).select("i", (cast(F.col("v")) * cast(F.col("x"))).alias("y"))
    return over_domain(products, a.n_rows, "i", ["y"])


def block_vectors(x: DataFrame, width: int) -> DataFrame:
    """(i, vec, x) as (i, xs): one array for each row."""
    columns = [F.sum(F.when(F.col("vec") == k, F.col("x"))).alias(f"x{k}") for k in range(width)]
    return x.groupBy("i").agg(*columns).select("i", F.array(*[F.coalesce(f"x{k}", F.lit(0.0)) for k in range(width)]).alias("xs"))


def spmmv_rowwise(a: SparseMatrix, xs: DataFrame, width: int) -> DataFrame:
    """Y = A X with X as (i, xs array): (i, ys). Each entry meets its row of X once."""
    met = a.entries.join(xs.select(F.col("i").alias("j"), "xs"), "j")
    products = met.select("i", *[(F.col("v") * F.get("xs", F.lit(k))).alias(f"y{k}") for k in range(width)])
    summed = over_domain(products, a.n_rows, "i", [f"y{k}" for k in range(width)])
    return summed.select("i", F.array(*[f"y{k}" for k in range(width)]).alias("ys"))


def spmmv_colwise(a: SparseMatrix, x: DataFrame, width: int) -> DataFrame:
    """Y = A X with X as (i, vec, x): (i, vec, y). A task sums up all vectors of a few rows."""
    met = by_rows(a.entries.select("i", "j", "v")).join(x.select(F.col("i").alias("j"), "vec", "x"), "j")
    products = met.select("i", "vec", (F.col("v") * F.col("x")).alias("y"))
    zeros = a.rows().select("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("vec")).withColumn("y", F.lit(0.0))
    return products.select("i", F.col("vec").cast("int").alias("vec"), "y").unionByName(zeros).groupBy("i", "vec").agg(F.sum("y").alias("y"))


def spmmv_expression(a: SparseMatrix, x: list[Column], width: int) -> DataFrame:
    """Y = A X where column k of X is the expression x[k] of j: (i, ys); no join at all."""
    products = a.entries.select("i", *[(F.col("v") * x[k]).alias(f"y{k}") for k in range(width)])
    summed = over_domain(products, a.n_rows, "i", [f"y{k}" for k in range(width)])
    return summed.select("i", F.array(*[f"y{k}" for k in range(width)]).alias("ys"))


def spmmv_tiled(a: SparseMatrix, x: DataFrame, width: int, tile: int = 16) -> DataFrame:
    """Y = A X of any width with X as (i, vec, x): (i, vec, y), 0.0 where there is no entry.

    X is cut into blocks of `tile` vectors; an entry meets a row of each block and makes
    `tile` products in place. So a task's row holds `tile` sums however wide X is, and
    there are width / tile times as many rows as entries instead of width times: entries
    and index are repeated once for a block. Entries are dealt out by row first, so that a
    task holds the sums of few rows. Sums are by (row, block), which also spreads
    a row with very many entries over as many tasks as there are blocks. Places of X that
    aren't given count as 0.
    """
    if width < 1 or tile < 1:
        raise ValueError("width and tile must be 1 at least")
    tile = min(tile, width)
    names, blocks = [f"y{k}" for k in range(tile)], -(-width // tile)
    value = [F.coalesce(F.sum(F.when(F.col("vec") % tile == k, F.col("x"))), F.lit(0.0)).alias(f"x{k}") for k in range(tile)]
    xs = x.where(F.col("vec").between(0, width - 1)).groupBy(F.col("i").alias("j"), F.expr(f"cast(vec div {tile} as int)").alias("block")).agg(*value)
    products = by_rows(a.entries.select("i", "j", "v")).join(xs, "j").select("i", "block", *[(F.col("v") * F.col(f"x{k}")).alias(n) for k, n in enumerate(names)])
    zeros = a.rows().select("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *[F.lit(0.0).alias(n) for n in names])
    sums = products.unionByName(zeros).groupBy("i", "block").agg(*[F.sum(n).alias(n) for n in names])
    each = sums.select("i", "block", F.posexplode(F.array(*names)).alias("k", "y"))
    return each.select("i", (F.col("block") * tile + F.col("k")).cast("int").alias("vec"), "y").where(F.col("vec") < width)
