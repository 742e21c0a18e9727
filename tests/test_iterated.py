"""Products over a matrix dealt out once, and sums that don't depend on the order."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomatrix import __main__ as command
from loomatrix.config import SpmvConfig
from loomatrix.operators import copartition, exact, iterate, spmv
from loomatrix.plans.matrix import SparseMatrix, constant


def test_bucketed_powers(spark):
    n = 300
    ids = spark.range(6 * n)
    a = SparseMatrix(ids.select((F.col("id") % n).alias("i"), (F.col("id") * 7 % n).alias("j"), (F.col("id") % 3).cast("double").alias("v")).unionByName(spark.range(n).select(F.col("id").alias("i"), F.lit(5).cast("long").alias("j"), F.lit(1.0).alias("v"))), n, n)
    m = copartition.bucketed(a)
    assert m.heavy == [] or 5 in m.heavy
    for times in (0, 1, 5):
        got = {r.i: r.y for r in copartition.power_bucketed(m, constant(1.0), times, cut_every=2).collect()}
        want = {r.i: r.y for r in iterate.power(a, constant(1.0), times).collect()}
        assert got == want and len(got) == n
    m.drop()
    with pytest.raises(ValueError, match="square"):
        copartition.bucketed(SparseMatrix(a.entries, n, n + 1))


def test_bucketed_heavy_columns(spark):
    """Columns with more than a bucket's share of the entries meet the vector apart."""
    rows = spark.range(4_000).select((F.col("id") % 1000).alias("i"), F.when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % 1000).cast("long").alias("j"), F.lit(1.0).alias("v"))
    a = SparseMatrix(rows, 1000, 1000)
    m = copartition.bucketed(a)
    assert m.heavy == [3] and m.hot.count() >= 2_000
    assert {r.i: r.y for r in copartition.power_bucketed(m, constant(2.0), 3).collect()} == {r.i: r.y for r in iterate.power(a, constant(2.0), 3).collect()}


def test_bucketed_plan(spark):
    """Eight steps: an exchange of the vector each, one more for where it begins and one for all rows, none of the matrix."""
    n = 2_000
    a = SparseMatrix(spark.range(8 * n).select((F.col("id") % n).alias("i"), (F.col("id") * 13 % n).alias("j"), F.lit(1.0).alias("v")), n, n)
    m = copartition.bucketed(a)
    y = copartition.power_bucketed(m, constant(1.0), 8, cut_every=9)
    y.collect()
    said = y._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning", said)) == 10 and said.count("Bucketed: true") == 8
    scans = [k for k, line in enumerate(said.splitlines()) if "Scan parquet" in line]
    lines = said.splitlines()
    for k in scans:  # nothing between a scan of the matrix and its join moves it
        above = "".join(lines[max(0, k - 4) : k])
        assert "Exchange" not in above.split("Join")[-1]


def spread(rnd, n):
    return [rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.randrange(-120, 120) for _ in range(n)]


def test_sums_are_exact(spark):
    rnd = random.Random(5)
    groups = {k: spread(rnd, rnd.randrange(1, 30)) for k in range(60)}
    for k in range(60, 90):  # sums that cancel but for little, and to nothing
        some = spread(rnd, 8)
        groups[k] = [*some, *[-x for x in some], *([rnd.random() * 1e-30] if k % 2 else [])]
    groups[90], groups[91], groups[92] = [0.0, -0.0], [5e-271, 2.0**959, -(2.0**959)], [1.0, 2.0**-53, 2.0**-120]
    groups[93], groups[94] = [1.0, 2.0**-53], [1.0, 3 * 2.0**-53, -(2.0**-140)]
    rows = [(k, x) for k, some in groups.items() for x in some]
    rnd.shuffle(rows)
    df = spark.createDataFrame([*rows, (95, None), (96, float("inf")), (96, 1.0), (97, float("inf")), (97, float("-inf"))], "k int, x double")
    results = []
    for parts in (1, 3, 7):
        got = {r.k: r.y for r in exact.sum_exactly(df.repartition(parts), ["k"], ["x"], "y").collect()}
        results.append({k: v.hex() for k, v in got.items()})
    assert results[0] == results[1] == results[2]
    assert {k: got[k] for k in groups} == {k: math.fsum(v) for k, v in groups.items()}
    assert got[95] == 0.0 and got[96] == math.inf and math.isnan(got[97])


def test_exact_products(spark):
    """Against fractions; the same bits for any partitioning."""
    rnd = random.Random(8)
    n = 12
    entries = [(rnd.randrange(n - 1), rnd.randrange(n), spread(rnd, 1)[0]) for _ in range(150)]
    x = spread(rnd, n)
    vector = spark.createDataFrame(list(enumerate(x)), "i bigint, x double")
    want = {i: float(sum((Fraction(v) * Fraction(x[j]) for r, j, v in entries if r == i), Fraction(0))) for i in range(n)}
    for parts in (1, 5):
        a = SparseMatrix(spark.createDataFrame(entries, "i bigint, j bigint, v double").repartition(parts), n, n)
        assert {r.i: r.y for r in exact.spmv_exact(a, vector).collect()} == want


def test_solve_mode_compares_with_exact_products(spark, monkeypatch):
    """A product that is wrong on both of the engine's usual ways is told."""
    a = SparseMatrix(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1e17), (0, 2, -1e17), (1, 1, 2.0), (2, 2, 1.0)], "i bigint, j bigint, v double"), 3, 3)
    monkeypatch.setattr(command, "load", lambda *_: a)
    right = command.run(spark, SpmvConfig(mode="solve", repetitions=2, format="coo")).first()
    assert right.n == 3
    monkeypatch.setattr(iterate, "spmv", lambda a, x, *_: exact.spmv_exact(a, x).withColumn("y", F.col("y") * 2))
    assert command.run(spark, SpmvConfig(mode="solve", repetitions=2, format="coo")).first().errors == 3


@pytest.mark.parametrize("width, tile", [(1, 16), (5, 2), (16, 16), (33, 16), (512, 16)])
def test_wide_blocks(spark, width, tile):
    """As many vectors as wanted, no row with more than `tile` sums; places of X may lack."""
    rnd = np.random.default_rng(width)
    entries = [(int(i), int(j), float(v)) for i, j, v in zip(rnd.integers(0, 6, 30), rnd.integers(0, 8, 30), rnd.integers(-9, 9, 30), strict=True)]
    x = rnd.integers(-9, 9, (8, width)).astype(float)
    x[3, :] = x[:, width - 1] = 0
    given = spark.createDataFrame([(j, k, float(x[j, k])) for j in range(8) for k in range(width) if x[j, k]], "i bigint, vec int, x double")
    a = SparseMatrix(spark.createDataFrame(entries, "i bigint, j bigint, v double"), 7, 8)
    want = np.zeros((7, 8))
    for i, j, v in entries:
        want[i, j] += v
    y = spmv.spmmv_tiled(a, given, width, tile)
    got = {(r.i, r.vec): r.y for r in y.collect()}
    assert got == {(i, k): float(want[i] @ x[:, k]) for i in range(7) for k in range(width)}
    assert f"y{min(tile, width)}" not in y._jdf.queryExecution().optimizedPlan().toString()
