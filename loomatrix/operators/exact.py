"""Sums that don't depend on the order: exact, and rounded once.

A double is a whole number of at most 53 bits times a power of two. It is cut at fixed
places, every 32 bits of the number line, into pieces that are whole numbers; those of
equal place are added up as longs, which is exact and the same in any order and any
partitioning. The sums are then normalised by carries and rounded to the nearest double.
A product is the sum of two doubles, itself and what its rounding lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix, Vector, by_rows, meet
from ..plans.tables import written

#: Bits between two places.
STEP = 32


def _power(k: Column) -> Column:
    """2 to the power of STEP * k, which is exact."""
    return F.pow(F.lit(2.0), k * STEP)


def product_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b as rounded, and the rest to the exact product (Dekker's product with Veltkamp's halves)."""
    def halves(x):
        big = x * 134217729.0
        high = big - (big - x)
        return high, x - high

    p, (a1, a2), (b1, b2) = a * b, halves(a), halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def sum_exactly(terms: DataFrame, keys: list[str], values: list[str], into: str) -> DataFrame:
    """For each key the sum of all values of its rows, exact and rounded to the nearest double.

    Null values don't count; a key without other values has 0.0. Where a value isn't
    finite the sum is that of such values. Values that aren't 0 must lie between 2^-900
    and 2^960 in size, and a key may have 2^30 rows.
    """
    each = terms.select(*keys, F.explode(F.array(*values)).alias("__t"))
    odd = ~(F.abs("__t") < float("inf"))
    each = each.select(*keys, F.when(odd, F.col("__t")).alias("__odd"), F.when(odd | (F.col("__t") == 0), None).otherwise(F.col("__t")).alias("__t"))
    size = F.abs("__t")
    about = F.floor(F.log2(size) / STEP)
    each = each.withColumn("__q", about)
    each = each.withColumn("__q", F.when(size >= _power(F.col("__q") + 1), F.col("__q") + 1).when(size < _power(F.col("__q")), F.col("__q") - 1).otherwise(F.col("__q")))
    rest, pieces = "__t", []
    for k in range(3):  # 53 bits touch three places at most
        unit = _power(F.col("__q") - k)
        whole = F.col(rest) / unit
        each = each.withColumn(f"__l{k}", F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast("long"))
        each = each.withColumn(f"__r{k}", F.col(rest) - F.col(f"__l{k}") * unit)
        rest = f"__r{k}"
        pieces.append(F.struct((F.col("__q") - k).alias("place"), F.col(f"__l{k}").alias("piece")))
    cut = each.select(*keys, "__odd", F.explode(F.array(*pieces)).alias("__p")).select(*keys, "__odd", "__p.*")
    sums = cut.groupBy(*keys, "place").agg(F.sum("piece").alias("piece"), F.sum("__odd").alias("__odd"))
    # some 70 places at most
    whole = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "piece")))).alias("__m"), F.min("place").alias("__low"), F.max("place").alias("__high"), F.sum("__odd").alias("__odd"))
    places = F.sequence("__low", F.col("__high") + 2)
    at = lambda k: F.coalesce(F.try_element_at("__m", k), F.lit(0))

    def normal(sign):
        """Digits from 0 to 2^32 - 1 of sign * sum, the highest first, and the carry that is left: 0 if the sum isn't negative."""
        start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

        def add(acc, k):
            total = at(k) * sign + acc["carry"]
            return F.struct(F.shiftright(total, STEP).alias("carry"), F.concat(F.array(total.bitwiseAND((1 << STEP) - 1)), acc["digits"]).alias("digits"))

        return F.aggregate(places, start, add)

    out = whole.withColumn("__up", normal(1)).withColumn("__n", F.when(F.col("__up.carry") < 0, normal(-1)["digits"]).otherwise(F.col("__up.digits")))
    # leading digits that aren't 0: three of them and whether anything follows decide the rounding
    out = out.withColumn("__skip", F.size("__n") - F.size(F.filter("__n", lambda d, k: F.exists(F.slice("__n", 1, k + 1), lambda x: x != 0))))
    digit = lambda k: F.coalesce(F.get("__n", F.col("__skip") + k), F.lit(0)).cast("decimal(38,1)")
    follows = F.exists(F.slice("__n", F.col("__skip") + 4, F.greatest(F.size("__n") - F.col("__skip") - 3, F.lit(0))), lambda x: x != 0)
    scale = lambda k: F.lit(str(1 << (STEP * k))).cast("decimal(21,0)")
    number = (digit(0) * scale(2)).cast("decimal(38,1)") + (digit(1) * scale(1)).cast("decimal(38,1)") + digit(2) + F.when(follows, F.expr("0.5BD")).otherwise(F.expr("0.0BD"))
    place = F.col("__high") + 2 - F.col("__skip") - 2
    value = number.cast("double") * _power(place) * F.when(F.col("__up.carry") < 0, -1.0).otherwise(1.0)
    total = F.when(F.col("__low").isNull() | (F.col("__skip") == F.size("__n")), 0.0).otherwise(value)
    return out.select(*keys, F.coalesce("__odd", total).alias(into))


def spmv_exact(a: SparseMatrix, x: Vector) -> DataFrame:
    """A x as (i, y), each row's sum of products exact and rounded once, 0.0 for rows without entries.

    A row has sums at several places, so entries are dealt out by row: a task holds those of few rows.
    """
    p, e = product_parts(F.col("v"), F.col("x"))
    products = meet(by_rows(a.entries.select("i", "j", F.col("v").cast("double").alias("v"))), x).select("i", p.alias("p"), e.alias("e"))
    zeros = a.rows().select("i", F.lit(0.0).alias("p"), F.lit(0.0).alias("e"))
    return sum_exactly(products.unionByName(zeros), ["i"], ["p", "e"], "y")


def power_exact(a: SparseMatrix, x: Vector, times: int) -> DataFrame:
    """A^times x as (i, y), each product exact and rounded once: what other ways to multiply are compared with."""
    if not a.square:
        raise ValueError("iterated products need a square matrix")
    if callable(x) and not isinstance(x, DataFrame):
        x = a.rows().select("i", x(F.col("i")).alias("x"))
    for _ in range(times):
        x = written(spmv_exact(a, x).withColumnRenamed("y", "x"))
    return x.withColumnRenamed("x", "y")
