"""The stored chunk format, and how many exchanges conversions and products take."""

import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomatrix.operators import precision, sell
from loomatrix.plans.matrix import SparseMatrix, constant
from loomatrix.plans.tables import new_path
from loomatrix.sources import stored

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def matrix(spark, entries, n_rows, n_cols):
    return SparseMatrix(spark.createDataFrame([(i, j, float(v)) for i, j, v in entries], "i bigint, j bigint, v double"), n_rows, n_cols)


def dense(entries, n_rows, n_cols):
    out = np.zeros((n_rows, n_cols))
    for i, j, v in entries:
        out[i, j] += v
    return out


def plan(df):
    """The final plan as executed."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(df):
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|single|round)", plan(df))) + len(re.findall("BroadcastExchange", plan(df)))


@few
@given(st.lists(st.tuples(st.integers(0, 10), st.integers(0, 6), st.integers(-5, 5)), max_size=40), st.sampled_from([(1, 1), (4, 8), (3, 1), (16, 4), (2, 1 << 20)]), st.integers(1, 40))
def test_stored_products(spark, entries, shape, part):
    a = matrix(spark, entries, 11, 7)
    kept = stored.store(sell.to_sell(a, *shape), new_path(spark, "test"), part)
    again = stored.open_stored(spark, kept.path)
    assert again == kept and again.nnz == len(entries)
    full, x = dense(entries, 11, 7), np.arange(7) % 3 + 1.0
    vector = spark.createDataFrame([(j, float(x[j])) for j in range(7)], "i bigint, x double")
    assert sorted((r.i, r.j, r.v) for r in again.entries().collect()) == sorted((i, j, float(v)) for i, j, v in entries)
    for rows in (None, (0, 11), (3, 8), (8, 8), (-2, 50)):
        for cols in (None, (2, 5)):
            lo, hi = (0, 11) if rows is None else (max(0, rows[0]), min(11, rows[1]))
            some = full.copy()
            if cols:
                some[:, : cols[0]] = some[:, cols[1] :] = 0
            got = {r.i: r.y for r in again.product(vector, rows=rows, cols=cols).collect()}
            assert got == {i: float(some[i] @ x) for i in range(lo, hi)}


def test_stored_by_another_permutation(spark):
    """Rows that moved anywhere are found by their range in each tile."""
    entries = [(i, (i * 3) % 20, i + 1) for i in range(20)]
    a = matrix(spark, entries, 20, 20)
    perm = spark.createDataFrame([(i, (i * 7) % 20) for i in range(20)], "i_old bigint, i_new bigint")
    kept = stored.store(sell.to_sell(a, 4, 4, perm), new_path(spark, "test"), 8, by_blocks=False)
    assert {r.i: r.y for r in kept.product(constant(1.0), rows=(5, 9)).collect()} == {i: i + 1.0 for i in range(5, 9)}
    assert {r.i for r in kept.matrix().entries.collect()} == set(range(20))


def test_stored_infinite_padding(spark):
    """Padding meets no element of x, not even an infinite one."""
    a = matrix(spark, [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], 2, 2)
    kept = stored.store(sell.to_sell(a, 2, 2), new_path(spark, "test"))
    x = spark.createDataFrame([(0, float("inf")), (1, 1.0)], "i bigint, x double")
    assert {r.i: r.y for r in kept.product(x).collect()} == {0: float("inf"), 1: 3.0}


def test_stored_scans_are_pruned(spark):
    n = 4096
    a = SparseMatrix(spark.range(4 * n).select((F.col("id") % n).alias("i"), (F.col("id") % n).alias("j"), F.lit(1.0).alias("v")), n, n)
    kept = stored.store(sell.to_sell(a, 16, 64), new_path(spark, "test"), n // 2)
    some = kept.product(constant(1.0), rows=(100, 200), cols=(0, 3000))
    said = plan(some)
    assert re.search(r"PartitionFilters: \[[^\]]*dir", said)
    assert all(f"GreaterThanOrEqual({c}" in said or f"LessThan({c}" in said for c in ("i_max", "i_min", "j_max", "j_min"))
    files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert files(kept.tiles((100, 200))) < files(kept.tiles()) / 3
    assert "ReadSchema: struct<c:" in said and "nnz" not in said.split("ReadSchema")[1]
    assert {r.y for r in some.collect()} == {4.0}
    assert exchanges(kept.product(constant(1.0))) == 1  # sums of rows only


def test_tiles_of_a_long_row_and_of_many_lanes(spark, monkeypatch):
    """A row much longer than a tile, and a chunk of all rows, stand in arrays of TILE elements."""
    long = SparseMatrix(spark.range(200_000).select(F.lit(1).cast("long").alias("i"), (F.col("id") * 7919 % 200_000).alias("j"), F.lit(1.0).alias("v")), 5, 200_000)
    wide = SparseMatrix(spark.range(5_000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("j"), F.lit(1.0).alias("v")), 5_000, 3)
    for a, chunk, want in ((long, 4, [0, 200_000.0, 0, 0, 0]), (wide, 5_000, [1.0] * 5_000)):
        m = sell.to_sell(a, chunk, 1)
        packed = sell.pack_chunks(m)
        most, tiles = packed.select(F.max(F.size("cols")), F.count("*")).first()
        assert most <= sell.TILE and tiles > 1
        got = {r.i: r.y for r in sell.spmv_packed(packed, m, constant(1.0)).collect()}
        assert [got[i] for i in range(a.n_rows)] == want
        kept = stored.store(m, new_path(spark, "test"))
        assert {r.i: r.y for r in kept.product(constant(1.0)).collect()} == got


@pytest.mark.parametrize("mode, t1, t2, most", [(None, None, None, 5), ("ap[dp_sp_hp]", 3.0, 1.0, 5)])
def test_conversion_moves_entries_once(spark, mode, t1, t2, most):
    """A product that converts on the way: entries once, then counts and sums of rows."""
    a = SparseMatrix(spark.range(20_000).select((F.col("id") % 500).alias("i"), (F.col("id") * 7 % 300).alias("j"), (F.col("id") % 5).cast("double").alias("v")), 500, 300)
    x = lambda j: (j % 7 + 1).cast("double")
    if mode is None:
        y = sell.spmv_sell(sell.to_sell(a, 16, 64), x)
    else:
        y = sell.spmv_sell_adaptive(sell.precision_chunks(a, precision.partition_precisions(a, mode, t1, t2), mode, 16, 64), x)
    assert exchanges(y) <= most
