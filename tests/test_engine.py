"""The engine's operators against plain loops, on small and random matrices."""

import math
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomatrix.config import SpmvConfig, parse
from loomatrix.functions.scalar import base_name, cantor_pairing, histogram_bucket, split_range, to_half
from loomatrix.operators import iterate, partition, precision, scale, sell, spmv, stats, validate
from loomatrix.plans.matrix import SparseMatrix, constant, random_vector
from loomatrix.plans.tables import ranked, running_sum
from loomatrix.sources import generate, matrix_market, reports
from loomatrix.streaming import deltas

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def matrix(spark, entries, n_rows, n_cols):
    rows = [(k, i, j, float(v)) for k, (i, j, v) in enumerate(entries)]
    return SparseMatrix(spark.createDataFrame(rows, "seq bigint, i bigint, j bigint, v double"), n_rows, n_cols)


def dense(entries, n_rows, n_cols):
    a = np.zeros((n_rows, n_cols))
    for i, j, v in entries:
        a[i, j] += v
    return a


def vector(df, n, column="y"):
    y = np.full(n, np.nan)
    for r in df.collect():
        y[r["i"]] = r[column]
    return y


@st.composite
def matrices(draw):
    n = draw(st.integers(1, 14))
    place = st.integers(0, n - 1)
    return n, draw(st.lists(st.tuples(place, place, st.integers(-9, 9)), max_size=40))


@few
@given(matrices(), st.sampled_from([(1, 1), (1, 2), (2, 4), (4, 4), (3, 100), (16, 1)]))
def test_formats_give_the_same_product(spark, made, shape):
    n, entries = made
    a, (chunk, sigma) = matrix(spark, entries, n, n), shape
    x = lambda j: (j % 7 + 1).cast("double")
    want = dense(entries, n, n) @ (np.arange(n) % 7 + 1)
    m = sell.to_sell(a, chunk, sigma)
    for y in (spmv.spmv(a, x), sell.spmv_sell(m, x), sell.spmv_packed(sell.pack_chunks(m), m, x), spmv.spmv(sell.unpack_rows(sell.pack_rows(a), n, n), x), spmv.spmv(sell.from_sell(m), x)):
        assert (vector(y, n) == want).all()
    perm = [r.i_new for r in m.perm.orderBy("i_old").collect()]
    assert sorted(perm) == list(range(m.n_padded))
    idx = [r.idx for r in m.elems.collect()]
    assert len(set(idx)) == len(entries)
    elements = m.metrics().first().n_elements
    assert all(0 <= k < elements for k in idx)


def plain_sell(lengths, chunk, sigma):
    """The row order and chunk widths by loops."""
    n = -(-len(lengths) // chunk) * chunk
    lengths = lengths + [0] * (n - len(lengths))
    order = []
    for b in range(0, n, sigma):
        order += sorted(range(b, min(n, b + sigma)), key=lambda i: (-lengths[i], i))
    return order, [max(lengths[i] for i in order[c : c + chunk]) for c in range(0, n, chunk)]


@pytest.mark.parametrize("chunk,sigma", [(1, 2), (1, 128), (4, 4), (2, 6)])
def test_row_order_and_chunks(spark, chunk, sigma, monkeypatch):
    rnd = np.random.default_rng(2)
    lengths = [int(x) for x in rnd.integers(0, 4, 23)]
    entries = [(i, int(rnd.integers(0, 23)), 1) for i, n in enumerate(lengths) for _ in range(n)]
    a = matrix(spark, entries, 23, 23)
    order, widths = plain_sell(lengths, chunk, sigma)
    for limit in (1 << 16, 1):
        monkeypatch.setattr(sell, "ONE_WINDOW_ROWS", limit)
        perm = sell.row_permutation(a, chunk, sigma)
        assert [r.i_old for r in perm.orderBy("i_new").collect()] == order
    chunks = sell.chunk_table(perm, chunk, 23).orderBy("c").collect()
    assert [r.len for r in chunks] == widths
    assert [r.ptr for r in chunks] == [chunk * sum(widths[:c]) for c in range(len(widths))]


def test_entry_order_and_fixed_permutation(spark):
    entries = [(0, 2, 5), (1, 0, 1), (0, 1, 7), (2, 2, 2), (0, 0, 0)]
    a = matrix(spark, entries, 3, 3)
    elems = sell.to_sell(a, 1, 1).elems.orderBy("idx").collect()
    assert [(r.j, r.v) for r in elems] == [(2, 5), (1, 7), (0, 0), (0, 1), (2, 2)]
    perm = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "i_old bigint, i_new bigint")
    m = sell.to_sell(a, 1, 1, perm)
    assert [r.len for r in m.chunks.orderBy("c").collect()] == [1, 1, 3]
    assert (vector(sell.spmv_sell(m, constant(1.0)), 3) == [12, 1, 2]).all()
    assert [r.ptr for r in sell.row_pointers(a).orderBy("i").collect()] == [0, 3, 4, 5]


def test_empty_matrix(spark):
    a = matrix(spark, [], 4, 4)
    m = sell.to_sell(a, 2, 2)
    assert (vector(sell.spmv_sell(m, constant()), 4) == 0).all() and m.metrics().first().beta is None
    assert stats.value_range(a).first().max_abs == 0 and stats.bandwidth(a).first().bandwidth == 1
    assert SparseMatrix.of(a.entries.drop("seq")).n_rows == 0


def test_blocks_of_vectors(spark):
    entries = [(0, 1, 2), (2, 0, 3), (2, 1, -1), (2, 1, 4)]
    a, x = matrix(spark, entries, 3, 2), np.array([[1.0, 2, 3], [4, 5, 6]])
    long = spark.createDataFrame([(i, k, float(x[i, k])) for i in range(2) for k in range(3)], "i bigint, vec int, x double")
    want = dense(entries, 3, 2) @ x
    col = {(r.i, r.vec): r.y for r in spmv.spmmv_colwise(a, long, 3).collect()}
    row = {r.i: r.ys for r in spmv.spmmv_rowwise(a, spmv.block_vectors(long, 3), 3).collect()}
    assert all(col[i, k] == want[i, k] == row[i][k] for i in range(3) for k in range(3))


def test_chunk_layout_products(spark):
    """Blocks, precisions and adaptive precision from the chunk layout, against numpy on the rounded values."""
    rnd = np.random.default_rng(3)
    entries = [(int(i), int(j), float(v)) for i, j, v in zip(rnd.integers(0, 9, 40), rnd.integers(0, 9, 40), rnd.normal(size=40) * 3, strict=True)]
    a = matrix(spark, entries, 9, 9)
    x = rnd.normal(size=(9, 3))
    xs = spark.createDataFrame([(i, x[i].tolist()) for i in range(9)], "i bigint, xs array<double>")
    one = spark.createDataFrame([(i, float(x[i, 0])) for i in range(9)], "i bigint, x double")
    real = {"dp": np.float64, "sp": np.float32, "hp": np.float16}
    kept = lambda m: replace(m, perm=m.perm.cache(), cells=m.cells.cache())  # noqa: E731 - laid out once, multiplied often
    rounded = lambda kind, some=entries: dense([(i, j, float(real[kind](v))) for i, j, v in some], 9, 9)
    for chunk, sigma in ((1, 2), (4, 8), (16, 1)):
        m = kept(sell.to_sell(a, chunk, sigma))
        for kind, number in real.items():
            want = rounded(kind) @ x.astype(number).astype(float)
            got = {r.i: r.ys for r in sell.spmmv_sell(m, xs, 3, kind).collect()}
            assert np.allclose([got[i] for i in range(9)], want, rtol=1e-14, atol=1e-14)
            assert np.allclose(vector(sell.spmv_sell(m, one, kind), 9), want[:, 0], rtol=1e-14, atol=1e-14)
        for mode, t1, t2 in (("ap[dp_sp]", 2.0, None), ("ap[dp_hp]", 2.0, None), ("ap[sp_hp]", 2.0, None), ("ap[dp_sp_hp]", 3.0, 1.0)):
            names, split = precision.BUCKETS[mode], precision.partition_precisions(a, mode, t1, t2)
            layouts = kept(sell.precision_chunks(a, split, mode, chunk, sigma))
            for name in names:
                mine = sell.to_sell(a.with_entries(split.where(F.col("prec") == name).drop("prec")), chunk, sigma)
                assert sorted(map(tuple, mine.elems.collect())) == sorted(map(tuple, layouts.elems.where(F.col("prec") == name).drop("prec").collect()))
            for own in ("highest", "own"):
                got = {r.i: r for r in sell.spmv_sell_adaptive(layouts, one, own).collect()}
                for k, name in enumerate(names):
                    high, low = [np.inf, t1, t2][k], [t1, t2, None][k] if k < len(names) - 1 else -1.0
                    some = [e for e in entries if low <= abs(e[2]) < high]
                    want = rounded(name, some) @ x[:, 0].astype(real[name if own == "own" else names[0]]).astype(float)
                    assert np.allclose([got[i][f"y_{name}"] for i in range(9)], want, rtol=1e-13, atol=1e-13)


def test_long_rows_in_segments(spark):
    a = SparseMatrix(spark.range(30_000).select((F.col("id") * 7919 % 20_000).alias("j"), F.lit(0).cast("long").alias("i"), F.lit(1.0).alias("v")), 2, 20_000)
    packed = sell.pack_rows(a)
    assert packed.count() > 1 and packed.agg(F.max(F.size("cols"))).first()[0] < 10_000
    assert vector(spmv.spmv(sell.unpack_rows(packed, 2, 20_000), constant(1.0)), 2).tolist() == [30_000.0, 0.0]


def test_permutations(spark):
    entries = [(0, 1, 2), (1, 2, 3), (2, 2, 4)]
    a = matrix(spark, entries, 3, 3)
    perm = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "i_old bigint, i_new bigint")
    p = np.zeros((3, 3))
    for r in perm.collect():
        p[r.i_new, r.i_old] = 1
    got = dense([(r.i, r.j, r.v) for r in sell.permute(a, perm).entries.collect()], 3, 3)
    assert (got == p @ dense(entries, 3, 3) @ p.T).all()
    remote = sell.permute_columns(spark.createDataFrame([(0, 7, 1.0), (0, 1, 1.0)], "i bigint, j bigint, v double"), perm, 3)
    assert sorted(r.j for r in remote.collect()) == [2, 7]


def test_half_matches_numpy(spark):
    values = [0.0, -0.0, 1.0, 1.0009765625, 2047.5, 2049.0, 65504.0, 65519.9, 65520.0, 1e30, 1e-8, 6e-8, 3e-5, -3.14159, 0.1, 5.960464477539063e-08, 2.9e-8]
    got = [r.h for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").select("k", to_half(F.col("v")).alias("h")).orderBy("k").collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in values]


@pytest.mark.parametrize("mode,t1,t2", [("ap[dp_sp]", 1.0, None), ("ap[dp_hp]", 1.0, None), ("ap[sp_hp]", 1.0, None), ("ap[dp_sp_hp]", 10.0, 0.5)])
@pytest.mark.parametrize("x_precision", ["highest", "own"])
def test_adaptive_precision(spark, mode, t1, t2, x_precision):
    rnd = np.random.default_rng(1)
    entries = [(int(rnd.integers(6)), int(rnd.integers(6)), float(rnd.normal() * 10.0 ** rnd.integers(-2, 3))) for _ in range(40)] + [(1, 1, 1.0), (1, 2, -1.0)]
    a, x = matrix(spark, entries, 6, 6), rnd.normal(size=6)
    split = precision.partition_precisions(a, mode, t1, t2)
    assert split.count() == 42
    names, kinds = precision.BUCKETS[mode], {"dp": np.float64, "sp": np.float32, "hp": np.float16}
    want = np.zeros(6)
    for i, j, v in entries:
        name = names[0] if abs(v) >= t1 else names[1] if len(names) == 2 or abs(v) >= t2 else names[2]
        want[i] += float(kinds[name](v)) * float(kinds[names[0] if x_precision == "highest" else name](x[j]))
    xs = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i bigint, x double")
    assert np.allclose(vector(precision.spmv_adaptive(a, split, xs, mode, x_precision), 6), want, rtol=1e-6 if names[0] == "sp" else 1e-13)


def test_equilibrate_and_thresholds(spark):
    entries = [(0, 0, 4), (0, 1, -2), (1, 1, 0), (2, 0, 8), (2, 1, 2)]
    a = matrix(spark, entries, 3, 2)
    b, rows, cols = scale.equilibrate(a)
    got = {(r.i, r.j): r.v for r in b.entries.collect()}
    assert got == {(0, 0): 1.0, (0, 1): -1.0, (1, 1): 0.0, (2, 0): 1.0, (2, 1): 0.5}
    split = {(r.i, r.j): r.prec for r in precision.partition_precisions(b, "ap[dp_sp]", 3.0, None, rows, cols).collect()}
    assert split[0, 0] == "dp" and split[2, 1] == "sp" and split[1, 1] == "sp"
    assert {(r.i, r.j) for r in scale.dropout(a, 4).entries.collect()} == {(0, 0), (2, 0)}


def test_statistics(spark):
    entries = [(0, 0, -3), (0, 3, 1), (3, 1, 0), (3, 1, 5)]
    a = matrix(spark, entries, 5, 5)
    r = stats.value_range(a).first()
    assert (r.min_abs, r.midrange, r.max_abs) == (0, 2.5, 5)
    b = stats.bandwidth(a).first()
    assert (b.lower, b.upper, b.bandwidth) == (2, 3, 6)
    d = stats.describe(sell.row_lengths(a), "n").first()
    assert (d["n"], d["min"], d["max"], d["avg"], d["median"]) == (5, 0, 2, 0.8, 0)
    assert d["std"] == pytest.approx(np.std([2, 0, 0, 2, 0])) and d["cv"] == pytest.approx(np.std([2, 0, 0, 2, 0]) / 0.8)
    assert stats.norm_threshold(a, 1e-6).first().norm_inf == 5
    assert sorted(tuple(x) for x in stats.value_histogram(a, 4).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    p = stats.matrix_profile(a).first()
    assert (p.nnz, p.empty_rows, p.longest_row, p.density) == (4, 3, 2, 0.16)


def test_histogram_buckets(spark):
    def plain(v):
        edges = [d * 10**k for k in range(6) for d in range(1, 10)]
        return v if v < 2 else min(80, 1 + sum(v > e for e in edges))

    values = [0, 1, 2, 3, 10, 11, 12, 20, 21, 99, 100, 101, 102, 1000, 1001, 54321]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = {r.v: r.b for r in df.select("v", histogram_bucket(F.col("v"), 80).alias("b")).collect()}
    assert [got[v] for v in values] == [plain(v) for v in values]
    with pytest.raises(Exception, match="negative"):
        stats.count_histogram(spark.createDataFrame([(-1,)], "v bigint"), "v").collect()


@few
@given(matrices(), st.integers(1, 5))
def test_partitions_and_halo(spark, made, parts):
    n, entries = made
    a = matrix(spark, entries, n, n)
    bounds = partition.segment_rows(a, parts)
    b = [(r.lo, r.hi) for r in bounds.orderBy("part").collect()]
    assert b[0][0] == 0 and b[-1][1] == n and all(x[1] == y[0] for x, y in zip(b, b[1:], strict=False))
    owner = lambda k: next(p for p, (lo, hi) in enumerate(b) if lo <= k < hi)
    want = {(owner(i), owner(j), j) for i, j, _ in entries if owner(i) != owner(j)}
    assert {tuple(r) for r in partition.halo_plan(a, bounds).collect()} == want
    local = {(r.part, r.owner, r.j): r.local for r in partition.halo_numbering(a, bounds).collect()}
    for p, (lo, hi) in enumerate(b):
        mine = sorted((x for x in want if x[0] == p), key=lambda x: (x[1] > p, x[1], x[2]))
        assert [local[x] for x in mine] == list(range(hi - lo, hi - lo + len(mine)))
    volume = {r.part: r.received for r in partition.communication_volume(a, bounds, 3).collect()}
    assert volume == {p: 3 * sum(x[0] == p for x in want) for p in range(parts)}
    balance = partition.part_balance(a, bounds).collect()
    assert sum(r.nnz for r in balance) == len(entries) and sum(r.n_rows for r in balance) == n
    assert sum(r.n for r in partition.send_plan(partition.halo_plan(a, bounds)).collect()) == len(want)


def test_segment_nnz(spark):
    entries = [(i, 0, 1) for i, n in enumerate([5, 0, 1, 1, 7, 2, 0, 4]) for _ in range(n)]
    a = matrix(spark, entries, 8, 8)
    rows = sorted(i for i, _, _ in entries)
    for parts in (1, 2, 3, 4):
        q = len(rows) // parts
        want = [rows[k * (q + 1) - 1] + 1 for k in range(1, parts)] + [8]
        if parts > 1 and want[-2] == 8:  # an empty last part moves the inner boundaries
            want = [x - 1 for x in want[:-1]] + [8]
        assert [r.hi for r in partition.segment_nnz(a, parts).orderBy("part").collect()] == want


def test_graph_parts(spark):
    entries = [(i, j, 1) for i in range(20) for j in range(20) if i != j and i % 2 == j % 2]
    a = matrix(spark, entries, 20, 20)
    parts = partition.graph_parts(a, 2, rounds=4)
    assert sorted(r["count"] for r in parts.groupBy("part").count().collect()) == [10, 10]
    b, perm = partition.by_parts(a, parts)
    assert sorted(r.i_new for r in perm.collect()) == list(range(20))
    assert (vector(sell.permute_vector(spmv.spmv(b, constant(1.0)).withColumnRenamed("y", "x"), sell.invert(perm)), 20, "x") == vector(spmv.spmv(a, constant(1.0)), 20)).all()


def test_edge_cut_falls(spark):
    """Two groups whose rows lie among each other: equal ranges cut half the links, graph parts fewer."""
    entries = [(i, j, 1) for i in range(24) for j in range(24) if i != j and (i // 3) % 2 == (j // 3) % 2]
    a = matrix(spark, entries, 24, 24)
    ranges = a.rows().withColumn("part", F.expr("cast(i div 12 as int)"))
    before, after = partition.edge_cut(a, ranges).first(), partition.edge_cut(a, partition.graph_parts(a, 2)).first()
    assert before.links == after.links == 132 and after.cut < before.cut


def test_solve_against_numpy(spark, tmp_path):
    """A run on a written file, in all formats, against the power of the dense matrix that the file says."""
    from loomatrix.__main__ import load, solve

    rnd = np.random.default_rng(5)
    entries = {(int(i), int(j)): float(rnd.integers(1, 9)) / 16 for i, j in rnd.integers(0, 12, (50, 2))}
    with open(tmp_path / "a.mtx", "w") as f:
        f.write(f"%%MatrixMarket matrix coordinate real general\n12 12 {len(entries)}\n" + "".join(f"{i + 1} {j + 1} {v!r}\n" for (i, j), v in entries.items()))
    want = np.linalg.matrix_power(dense([(i, j, v) for (i, j), v in entries.items()], 12, 12), 5) @ np.full(12, 5.0)
    a = load(spark, str(tmp_path / "a.mtx"))
    for layout in ({"format": "coo"}, {"format": "crs"}, {"format": "scs", "chunk": 4, "sigma": 8}, {"format": "coo", "parts": 3, "segmentation": "nnz"}):
        assert np.allclose(vector(solve(a, SpmvConfig(mode="solve", repetitions=5, **layout)), 12), want, rtol=1e-12)


def test_power_and_modes(spark):
    a = generate.stencil_2d(spark, 4)
    d = dense([(r.i, r.j, r.v) for r in a.entries.collect()], 16, 16)
    assert (d == d.T).all() and (np.diag(d) == 4).all()
    assert np.allclose(vector(iterate.power(a, constant(), 5, cut_every=2), 16), np.linalg.matrix_power(d, 5) @ np.full(16, 5.0))
    for config in (SpmvConfig(), SpmvConfig(format="scs", chunk=4, sigma=8), SpmvConfig(format="coo", precision="hp"), SpmvConfig(precision="ap[dp_sp]", equilibrate=True), SpmvConfig(dropout=True, dropout_threshold=2.0)):
        y = vector(iterate.execute(a, config), 16)
        want = (np.diag(np.diag(d)) if config.dropout else d / 4 if config.equilibrate else d) @ np.full(16, 5.0)
        assert np.allclose(y, want)
    with pytest.raises(ValueError, match="square"):
        iterate.power(matrix(spark, [(0, 1, 1)], 1, 2), constant(), 1)
    figures = iterate.benchmark(a, SpmvConfig(bench_seconds=0.01, format="coo")).first()
    assert figures.products >= 2 and figures.gflops == pytest.approx(2 * 64 / figures.seconds / 1e9)


def test_execute_keeps_options(spark, monkeypatch):
    """Every format rounds as the precision says and comes out of its layout; row parts change no product."""
    a = matrix(spark, [(0, 0, 1 / 3), (0, 1, 2.1), (1, 1, 1 / 7)], 2, 2)
    x = lambda j: 1.0 / (j + 3)
    layouts = [{"format": "coo"}, {"format": "crs"}, {"format": "scs", "chunk": 2, "sigma": 2}]
    for kind, real in (("sp", np.float32), ("hp", np.float16)):
        v, w = [float(real(t)) for t in (1 / 3, 2.1, 1 / 7)], [float(real(1 / (j + 3))) for j in range(2)]
        want = [v[0] * w[0] + v[1] * w[1], v[2] * w[1]]
        for layout in layouts:
            assert np.allclose(vector(iterate.execute(a, SpmvConfig(precision=kind, **layout), x), 2), want, rtol=1e-14, atol=0)
    made = []
    monkeypatch.setattr(iterate, "to_sell", lambda *args, kept=iterate.to_sell: made.append("to_sell") or kept(*args))
    adaptive = [vector(iterate.execute(a, SpmvConfig(precision="ap[dp_sp]", **layout), x), 2) for layout in layouts]
    assert made == ["to_sell"] and np.allclose(adaptive[1], adaptive[0]) and np.allclose(adaptive[2], adaptive[0])
    plain = vector(iterate.execute(a, SpmvConfig(format="coo")), 2)
    for more in ({"parts": 2}, {"parts": 2, "segmentation": "nnz"}, {"parts": 2, "segmentation": "graph", "format": "scs", "chunk": 2}):
        assert np.allclose(vector(iterate.execute(a, SpmvConfig(**more)), 2), plain)


def test_benchmark_block(spark, monkeypatch):
    """A block's figure counts vectors that are really multiplied, in every layout; else it is refused."""
    a = generate.stencil_2d(spark, 4)
    d = dense([(r.i, r.j, r.v) for r in a.entries.collect()], 16, 16)
    x = np.array([[(i + k) % 7 + 1 for k in range(3)] for i in range(16)], float)
    made = []
    kept = iterate.execute_block
    monkeypatch.setattr(iterate, "execute_block", lambda *args: made.append(kept(*args)) or made[-1])
    for config in (SpmvConfig(block_width=3), SpmvConfig(block_width=3, format="scs", chunk=4, sigma=8, precision="sp"), SpmvConfig(block_width=3, format="coo", precision="hp")):
        got = {r.i: r.ys for r in kept(a, config).collect()}
        assert np.allclose([got[i] for i in range(16)], d @ x)
    figures = iterate.benchmark(a, SpmvConfig(block_width=3, bench_seconds=0.01, format="coo", warm_ups=0)).first()
    assert len(made) == figures.products and len(made[0].first().ys) == 3
    assert figures.gflops == pytest.approx(2 * 64 * 3 / figures.seconds / 1e9)
    for more in ({"mode": "solve"}, {"precision": "ap[dp_sp]"}):
        with pytest.raises(ValueError, match="block"):
            SpmvConfig(block_width=3, **more)


def test_generators(spark):
    b = {(r.i, r.j): r.v for r in generate.band(spark, 4, 1, 2).entries.collect()}
    assert b == {(i, j): 1 / (1 + abs(i - j)) for i in range(4) for j in range(4) if -1 <= j - i <= 2}
    r1 = sorted(map(tuple, generate.random_matrix(spark, 6, 3).entries.collect()))
    assert len(r1) == 18 and r1 == sorted(map(tuple, generate.random_matrix(spark, 6, 3).entries.repartition(3).collect()))
    x = [r.x for r in random_vector(spark, 50, 2.0, 3.0).collect()]
    assert len(set(x)) > 40 and all(2 <= v < 3 for v in x)


def test_matrix_market(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    sym = put("s.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% note\n\n3 3 3\n1 1 2.5\n3 1 -1e-3\n2 2 0\n")
    m = matrix_market.read_matrix(spark, sym)
    assert [(r.i, r.j, r.v) for r in m.entries.orderBy("seq").collect()] == [(0, 0, 2.5), (2, 0, -1e-3), (0, 2, -1e-3), (1, 1, 0.0)]
    pat = matrix_market.read_matrix(spark, put("p.mtx", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n"))
    assert [tuple(r) for r in pat.entries.select("i", "j", "v").collect()] == [(1, 0, 0.01)]
    for name, text, why in (
        ("a.mtx", "%%MatrixMarket matrix coordinate real general\n2 3 1\n1 1 1\n", "square"),
        ("b.mtx", "%%MatrixMarket matrix coordinate complex general\n2 2 1\n1 1 1 0\n", "only real"),
        ("c.mtx", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", "entries"),
        ("d.mtx", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n", "entries"),
        ("e.mtx", "no banner\n", "banner"),
    ):
        with pytest.raises(ValueError, match=why):
            matrix_market.read_matrix(spark, put(name, text))
    big = generate.random_matrix(spark, 40, 4)
    matrix_market.write_matrix(big, str(tmp_path / "out"), comment="made by rule")
    back = matrix_market.read_matrix(spark, str(tmp_path / "out"))
    key = lambda e: (e[0], e[1], e[2])
    one, two = sorted((tuple(r) for r in big.entries.collect()), key=key), sorted((tuple(r) for r in back.entries.select("i", "j", "v").collect()), key=key)
    assert [x[:2] for x in one] == [x[:2] for x in two] and np.allclose([x[2] for x in one], [x[2] for x in two], rtol=1e-15)
    whole = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert whole.startswith("%%MatrixMarket matrix coordinate real general\n% made by rule\n40 40 160\n") and len(whole.splitlines()) == 163


def test_validation(spark):
    ref = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 100.0), (3, 5.0), (4, 0.0)], "i bigint, y double")
    got = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 100.05), (3, 6.0), (4, float("nan"))], "i bigint, y double")
    c = validate.compare(got, ref)
    assert {r.i: r.verdict for r in c.collect()} == {0: "OK", 1: "OK", 2: "WARNING", 3: "ERROR", 4: "ERROR"}
    s = validate.summary(c.where("i < 4")).first()
    assert (s.errors, s.warnings, s.at_relative, s.max_absolute) == (1, 1, 3, 1.0) and s.magnitude == pytest.approx(math.sqrt(1 + 1e4 + 25))
    assert validate.mismatches(c.where("i < 4"), 1e-2).first().mismatches == 1
    assert [r.i for r in validate.first_mismatches(c.where("i < 4"), 1e-5).collect()] == [2, 3]
    assert validate.compare(got.where("i = 0"), ref).where("verdict = 'ERROR'").count() == 4


def test_streaming(spark, tmp_path):
    folder, entries = str(tmp_path / "in"), [(i % 5, i % 3, float(i)) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(entries[10 * k : 10 * k + 10], deltas.SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    y = deltas.running_product(deltas.read_deltas(spark, folder, 1), lambda j: (j + 1).cast("double"))
    y.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start().awaitTermination()
    want = dense(entries, 5, 3) @ np.arange(1, 4)
    assert (vector(spark.table("running"), 5) == want).all()


def test_numbering(spark):
    df = spark.createDataFrame([(g, k, (k * 7) % 5) for g in (0, 1) for k in range(40)], "g int, k bigint, v int")
    sums = running_sum(df, "k", F.col("v"), 40, "s", ("g",)).orderBy("g", "k").collect()
    assert [r.s for r in sums if r.g == 1] == [sum((j * 7) % 5 for j in range(k)) for k in range(40)]
    ranks = ranked(df, ["g"], ["k"], F.expr("k div 6"), "r").collect()
    assert all(r.r == r.k for r in ranks)


def test_scalars(spark):
    df = spark.createDataFrame([(3, 4, "/a/b/name.tar.mtx")], "a int, b int, p string")
    r = df.select(cantor_pairing(F.col("a"), F.col("b")).alias("t"), base_name(F.col("p")).alias("n")).first()
    assert (r.t, r.n) == (7 * 8 // 2 + 4, "name.tar")
    assert split_range(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]


def test_reports(spark, tmp_path):
    figures = spark.createDataFrame([("m", 1.5)], "matrix string, gflops double")
    reports.append_figures(figures, str(tmp_path / "f"))
    reports.append_figures(figures, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 2
    (tmp_path / "log.txt").write_text("x\nPerf (GF/s): 12.5e1 done\nother 3\n")
    assert [tuple(r) for r in reports.scrape(spark, str(tmp_path / "log.txt"), "Perf (GF/s)").collect()] == [("log.txt", 125.0)]


def test_configuration():
    c = parse(["m.mtx", "scs", "-c", "16", "-s", "64", "--mode", "solve", "--dropout-threshold", "0.5"])
    assert (c.matrix, c.format, c.chunk, c.sigma, c.mode, c.dropout, c.dropout_threshold) == ("m.mtx", "scs", 16, 64, "solve", True, 0.5)
    for bad in ({"format": "x"}, {"chunk": 2}, {"precision": "ap[dp_sp_hp]", "threshold_1": 0.1, "threshold_2": 1.0}, {"parts": 0}, {"bench_seconds": 0}):
        with pytest.raises(ValueError):
            SpmvConfig(**bad)


def test_command_line(spark, tmp_path):
    from loomatrix.__main__ import run

    r = run(spark, parse(["stencil:4", "scs", "-c", "4", "-s", "8", "--mode", "solve", "--repetitions", "3", "--random-x", "1", "--output", str(tmp_path / "c")])).first()
    assert (r.n, r.errors, r.warnings) == (16, 0, 0) and spark.read.parquet(str(tmp_path / "c")).count() == 16
    assert run(spark, parse(["band:8:1:1", "coo", "--bench-seconds", "0.01", "--warm-ups", "0", "--output", str(tmp_path / "f")])).first().nnz == 22
    low = run(spark, parse(["random:20:3", "crs", "--precision", "ap[dp_sp]", "--mode", "solve", "--repetitions", "2"])).first()
    assert low.errors == 0
