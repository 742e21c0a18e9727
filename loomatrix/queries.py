"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import cantor_pairing, to_single
from .operators import copartition, exact, multilevel, ordering, partition, precision, scale, sell, spmv, stats, validate
from .operators.iterate import execute, power
from .config import SpmvConfig
from .plans import matrix
from .plans.matrix import SparseMatrix, constant
from .plans.tables import new_path
from .sources import generate, matrix_market, mtx_source, stored, tables
from .streaming import deltas

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
CHUNK, SIGMA, PARTS, THRESHOLD = 16, 64, 7, 25.0


def query(sql: str | None):
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = " ".join(sql.split())
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- SQL that several queries share
A = "A AS (SELECT l_partkey AS i, l_suppkey AS j, l_quantity AS v FROM lineitem)"
N = "(SELECT max(p_partkey) + 1 FROM part)"
R = f"R AS (SELECT CAST(unnest(range({N})) AS BIGINT) AS i)"
#: Rows that fill the last chunk, and the row lengths.
PAD = f"P AS (SELECT CAST(unnest(range(CAST(ceil({N} / {CHUNK}.0) AS BIGINT) * {CHUNK})) AS BIGINT) AS i), L AS (SELECT P.i, count(A.i) AS n FROM P LEFT JOIN A ON A.i = P.i GROUP BY 1)"
PERM = f"S AS (SELECT i AS i_old, (i // {SIGMA}) * {SIGMA} + row_number() OVER (PARTITION BY i // {SIGMA} ORDER BY n DESC, i) - 1 AS i_new, n FROM L)"
CHUNKS = f"K AS (SELECT i_new // {CHUNK} AS c, max(n) AS len FROM S GROUP BY 1), C AS (SELECT c, len, CAST(coalesce(sum(len * {CHUNK}) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM K)"
SELL = f"{A}, {PAD}, {PERM}, {CHUNKS}"


def product(x: str = "5.0", a: str = A) -> str:
    return f"WITH {a}, {R} SELECT R.i, coalesce(sum(v * ({x})), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1"


SEVEN = "CAST(j % 7 + 1 AS DOUBLE)"


def seven(i):
    """A vector with values 1 to 7."""
    return (i % 7 + 1).cast("double")


def _ps(spark, sf_dir, square=False) -> SparseMatrix:
    return tables.parts_by_suppliers(spark, sf_dir, square=square)


def _large(spark, sf_dir) -> SparseMatrix:
    """Entries with whole values that need more than a float's 24 bits."""
    a = tables.parts_by_suppliers(spark, sf_dir, "l_extendedprice")
    return a.with_entries(a.entries.withColumn("v", F.round(F.col("v") * 100) * 64 + 1))


LARGE = "A AS (SELECT l_partkey AS i, l_suppkey AS j, round(l_extendedprice * 100) * 64 + 1 AS v FROM lineitem)"
LIMIT = 200_000_000.0

# ---- products


@query(product())
def spmv_coo(spark, sf_dir):
    return spmv.spmv(_ps(spark, sf_dir), constant())


@query(f"WITH {A}, {R} SELECT R.i, coalesce(sum(v * (s_nationkey + 1)), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i LEFT JOIN supplier ON s_suppkey = j GROUP BY 1")
def spmv_vector_join(spark, sf_dir):
    x = tables.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + 1.0).alias("x"))
    return spmv.spmv(_ps(spark, sf_dir), x)


@query(product(SEVEN, "A AS (SELECT l_partkey AS i, l_suppkey AS j, l_quantity AS v FROM lineitem WHERE l_quantity > 49)"))
def spmv_empty_rows(spark, sf_dir):
    a = _ps(spark, sf_dir)
    return spmv.spmv(a.with_entries(a.entries.where("v > 49")), seven)


@query("WITH A AS (SELECT o_custkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey), R AS (SELECT CAST(unnest(range((SELECT max(c_custkey) + 1 FROM customer))) AS BIGINT) AS i) "
       f"SELECT R.i, coalesce(sum(v * {SEVEN}), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")  # fmt: skip
def spmv_customers(spark, sf_dir):
    return spmv.spmv(tables.customers_by_parts(spark, sf_dir), seven)


@query(product(SEVEN))
def spmv_crs(spark, sf_dir):
    a = _ps(spark, sf_dir)
    return sell.spmv_rows(sell.pack_rows(a), a.n_rows, seven)


@query(product(SEVEN))
def spmv_sell_c16_s64(spark, sf_dir):
    return sell.spmv_sell(sell.to_sell(_ps(spark, sf_dir), CHUNK, SIGMA), seven)


@query(product(SEVEN))
def spmv_sell_packed(spark, sf_dir):
    m = sell.to_sell(_ps(spark, sf_dir), CHUNK, SIGMA)
    return sell.spmv_packed(sell.pack_chunks(m), m, seven)


def _stored(spark, sf_dir) -> stored.StoredMatrix:
    """Laid out and written once, in directories of about 1/8 of the padded elements."""
    m = sell.to_sell(_ps(spark, sf_dir), CHUNK, SIGMA)
    return stored.store(m, new_path(spark, "chunks"), part_elements=max(1, m.chunks.agg(F.sum("len")).first()[0] * CHUNK // 8))


@query(product(SEVEN))
def spmv_stored(spark, sf_dir):
    return _stored(spark, sf_dir).product(seven)


@query(f"WITH {A}, {R} SELECT R.i, coalesce(sum(v * {SEVEN}), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i WHERE R.i >= {N} // 4 AND R.i < {N} // 2 GROUP BY 1")
def spmv_stored_rows(spark, sf_dir):
    """The second quarter of the rows, from the directories that hold it."""
    kept = _stored(spark, sf_dir)
    return kept.product(seven, rows=(kept.n_rows // 4, kept.n_rows // 2))


@query(f"WITH {A}, {R}, W AS (SELECT max(s_suppkey) + 1 AS w FROM supplier) SELECT R.i, coalesce(sum(v * {SEVEN}) FILTER (j >= w // 3 AND j < w // 2), 0.0) AS y FROM W, R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmv_stored_cols(spark, sf_dir):
    """x is 0 outside a range of columns; tiles without such columns are skipped."""
    kept = _stored(spark, sf_dir)
    return kept.product(seven, cols=(kept.n_cols // 3, kept.n_cols // 2))


@query(f"WITH {SELL} SELECT C.c, len, ptr, min(i_old) AS i_min, max(i_old) AS i_max, (SELECT min(j) FROM A JOIN S s ON s.i_old = A.i WHERE s.i_new // {CHUNK} = C.c) AS j_min, (SELECT max(j) FROM A JOIN S s ON s.i_old = A.i WHERE s.i_new // {CHUNK} = C.c) AS j_max, CAST(sum(n) AS BIGINT) AS nnz FROM C JOIN S ON S.i_new // {CHUNK} = C.c WHERE len > 0 GROUP BY ALL")
def stored_chunks(spark, sf_dir):
    """What a stored matrix knows of each chunk that has elements."""
    least, most = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
    return _stored(spark, sf_dir).tiles().groupBy("c", "len", "ptr").agg(least("i_min"), most("i_max"), least("j_min"), most("j_max"), F.sum("nnz").alias("nnz"))


@query(product(SEVEN))
def spmv_ell(spark, sf_dir):
    a = _ps(spark, sf_dir)
    return sell.spmv_sell(sell.to_sell(a, a.n_rows, 1), seven)


@query(product("5.0"))
def spmv_configured(spark, sf_dir):
    return execute(_ps(spark, sf_dir), SpmvConfig(format="scs", chunk=8, sigma=32))


@query(f"WITH {LARGE}, {R} SELECT R.i, coalesce(sum(CAST(CAST(v AS REAL) AS DOUBLE) * {SEVEN}), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmv_single(spark, sf_dir):
    return spmv.spmv(_large(spark, sf_dir), seven, "sp")


@query(f"WITH {LARGE}, {R} SELECT R.i, coalesce(sum(CAST(CAST(v AS REAL) AS DOUBLE) * {SEVEN}), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmv_sell_sp(spark, sf_dir):
    return sell.spmv_sell(sell.to_sell(_large(spark, sf_dir), CHUNK, SIGMA), seven, "sp")


@query(product("(SELECT min(abs(v)) + (max(abs(v)) - min(abs(v))) / 2 FROM A)"))
def spmv_midrange_x(spark, sf_dir):
    """The vector that is the middle of the entries' sizes everywhere."""
    a = _ps(spark, sf_dir)
    return spmv.spmv(a, constant(stats.value_range(a).first().midrange))


@query("WITH V AS (SELECT CAST(unnest(range((SELECT max(s_suppkey) + 1 FROM supplier))) AS BIGINT) AS i) SELECT i, 1.0 + CAST(CAST('0x' || substr(md5('42:' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * 49.0 AS x FROM V")
def random_vector(spark, sf_dir):
    """Uniform between the least and the largest quantity."""
    a = _ps(spark, sf_dir)
    return matrix.random_vector(spark, a.n_cols, 1.0, 50.0)


@query(product(SEVEN))
def spmv_parts_nnz(spark, sf_dir):
    return execute(_ps(spark, sf_dir), SpmvConfig(format="coo", parts=PARTS, segmentation="nnz"), seven)


FOUR = ", ".join(f"coalesce(sum(v * ((j * {k + 1}) % 7 + 1)), 0.0) AS y{k}" for k in range(4))


@query(f"WITH {A}, {R} SELECT R.i, {FOUR} FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmmv_rowwise_b4(spark, sf_dir):
    a = _ps(spark, sf_dir)
    j = F.col("id")
    xs = spark.range(a.n_cols).select(j.alias("i"), F.array(*[(j * (k + 1) % 7 + 1).cast("double") for k in range(4)]).alias("xs"))
    return spmv.spmmv_rowwise(a, xs, 4).select("i", *[F.get("ys", F.lit(k)).alias(f"y{k}") for k in range(4)])


@query(f"WITH {A}, {R} SELECT R.i, {FOUR} FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmmv_sell_b4(spark, sf_dir):
    m, j = sell.to_sell(_ps(spark, sf_dir), CHUNK, SIGMA), F.col("id")
    xs = spark.range(m.n_cols).select(j.alias("i"), F.array(*[(j * (k + 1) % 7 + 1).cast("double") for k in range(4)]).alias("xs"))
    return sell.spmmv_sell(m, xs, 4).select("i", *[F.get("ys", F.lit(k)).alias(f"y{k}") for k in range(4)])


@query(f"WITH {A}, {R} SELECT R.i, {FOUR} FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmmv_expression_b4(spark, sf_dir):
    x = [(F.col("j") * (k + 1) % 7 + 1).cast("double") for k in range(4)]
    return spmv.spmmv_expression(_ps(spark, sf_dir), x, 4).select("i", *[F.get("ys", F.lit(k)).alias(f"y{k}") for k in range(4)])


@query(f"WITH {A}, {R}, V AS (SELECT CAST(unnest(range(4)) AS INTEGER) AS vec) SELECT R.i, vec, coalesce(sum(v * ((j * (vec + 1)) % 7 + 1)), 0.0) AS y FROM R CROSS JOIN V LEFT JOIN A ON A.i = R.i GROUP BY 1, 2")
def spmmv_colwise_b4(spark, sf_dir):
    a = _ps(spark, sf_dir)
    x = spark.range(a.n_cols).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("vec"))
    return spmv.spmmv_colwise(a, x.withColumn("x", (F.col("i") * (F.col("vec") + 1) % 7 + 1).cast("double")), 4)


@query(f"WITH {A}, {R}, V AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS vec), E AS (SELECT i, vec, sum(v * ((j * (vec + 1)) % 7 + 1)) AS y FROM A, V GROUP BY 1, 2) SELECT R.i, V.vec, coalesce(y, 0.0) AS y FROM R CROSS JOIN V LEFT JOIN E ON E.i = R.i AND E.vec = V.vec")
def spmmv_tiled_b40(spark, sf_dir):
    """Forty vectors in blocks of sixteen, the last one narrower."""
    a = _ps(spark, sf_dir)
    x = spark.range(a.n_cols).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("vec"))
    return spmv.spmmv_tiled(a, x.withColumn("x", (F.col("i") * (F.col("vec") + 1) % 7 + 1).cast("double")), 40)


NSQ = "greatest((SELECT max(p_partkey) + 1 FROM part), (SELECT max(s_suppkey) + 1 FROM supplier))"
RSQ = f"R AS (SELECT CAST(unnest(range({NSQ})) AS BIGINT) AS i)"


def _step(k: int) -> str:
    return f"Y{k} AS (SELECT R.i, coalesce(sum(v * y), 0.0) AS y FROM R LEFT JOIN (SELECT A.i, v, y FROM A JOIN Y{k - 1} ON Y{k - 1}.i = A.j) t ON t.i = R.i GROUP BY 1)"


@query(f"WITH {A}, {RSQ}, Y0 AS (SELECT i, 5.0 AS y FROM R), {_step(1)}, {_step(2)}, {_step(3)} SELECT i, y FROM Y3")
def spmv_power_3(spark, sf_dir):
    return power(_ps(spark, sf_dir, square=True), constant(), 3)


WALKS = "A AS (SELECT l_partkey AS i, l_suppkey AS j, 1.0::DOUBLE AS v FROM lineitem)"


@query(f"WITH {WALKS}, {RSQ}, Y0 AS (SELECT i, 5.0::DOUBLE AS y FROM R), {', '.join(_step(k) for k in range(1, 9))} SELECT i, y FROM Y8")
def spmv_power_8(spark, sf_dir):
    """Walks of eight steps; the matrix is dealt out once."""
    a = _ps(spark, sf_dir, square=True)
    return copartition.power_bucketed(copartition.bucketed(a.with_entries(a.entries.withColumn("v", F.lit(1.0)))), constant(), 8)


@query(f"WITH {LARGE}, {R} SELECT R.i, CAST(coalesce(sum((v % 1000) * {SEVEN}), 0) AS DOUBLE) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmv_exact_cancelling(spark, sf_dir):
    """Each entry between two that cancel and are 2^60 times as large, which a sum of doubles loses."""
    a = _large(spark, sf_dir)
    three = F.array(F.col("v") * float(1 << 60), F.col("v") % 1000, F.col("v") * -float(1 << 60))
    return exact.spmv_exact(a.with_entries(a.entries.select("i", "j", F.explode(three).alias("v"))), seven)


SIDE = "(SELECT CAST(floor(sqrt(max(p_partkey) + 1)) AS BIGINT) AS w FROM part)"


@query(f"WITH W AS {SIDE}, G AS (SELECT CAST(unnest(range(w * w)) AS BIGINT) AS i, w FROM W) SELECT i, CAST(4 - (i >= w)::INT - (i < w * w - w)::INT - (i % w > 0)::INT - (i % w < w - 1)::INT AS DOUBLE) AS y FROM G")
def spmv_stencil(spark, sf_dir):
    """The largest square grid that has no more points than there are parts."""
    n = tables.read(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1
    return spmv.spmv(generate.stencil_2d(spark, math.isqrt(n)), constant(1.0))


@query(product(SEVEN))
def matrix_market_round_trip(spark, sf_dir):
    a, folder = _ps(spark, sf_dir), new_path(spark, "mtx")
    matrix_market.write_matrix(a, folder)
    return spmv.spmv(matrix_market.read_matrix(spark, folder, square=False), seven)


@query(product(SEVEN))
def mtx_source_round_trip(spark, sf_dir):
    """Written and read by the mtx data source, each file in byte ranges."""
    folder = new_path(spark, "mtx")
    mtx_source.save(_ps(spark, sf_dir), folder)
    return spmv.spmv(mtx_source.load(spark, folder, split=1 << 20), seven)


@query("WITH A AS (SELECT l_partkey AS i, l_suppkey AS j, l_quantity AS v FROM lineitem) SELECT i, sum(v * 5.0) AS y FROM A GROUP BY 1")
def streaming_product(spark, sf_dir):
    """The whole table as a stream of entries; what the last batch leaves."""
    folder = new_path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    entries = lines.select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    stream = deltas.running_product(entries, constant()).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    stream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/y")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/y")


# ---- storage formats


@query(f"WITH {A}, {PAD}, {PERM} SELECT i_old, i_new, n FROM S")
def sell_permutation(spark, sf_dir):
    return sell.row_permutation(_ps(spark, sf_dir), CHUNK, SIGMA)


@query(f"WITH {A}, {PAD} SELECT i AS i_old, row_number() OVER (ORDER BY n DESC, i) - 1 AS i_new, n FROM L")
def sell_global_sort(spark, sf_dir):
    return sell.row_permutation(_ps(spark, sf_dir), CHUNK, 1 << 40)


@query(f"WITH {SELL} SELECT c, len, ptr FROM C")
def sell_chunks(spark, sf_dir):
    a = _ps(spark, sf_dir)
    return sell.chunk_table(sell.row_permutation(a, CHUNK, SIGMA), CHUNK, a.n_rows)


@query(f"WITH {SELL}, E AS (SELECT i, j, v, row_number() OVER (PARTITION BY i ORDER BY j, v) - 1 AS k FROM A) SELECT C.ptr + k * {CHUNK} + i_new % {CHUNK} AS idx, C.c, k, i_new % {CHUNK} AS lane, j, v FROM E JOIN S ON i_old = i JOIN C ON C.c = i_new // {CHUNK}")
def sell_elements(spark, sf_dir):
    return sell.to_sell(_ps(spark, sf_dir), CHUNK, SIGMA).elems


@query(f"WITH {SELL}, M AS (SELECT count(*) AS n_chunks, CAST(sum(len) * {CHUNK} AS BIGINT) AS n_elements FROM C), T AS (SELECT count(*) AS nnz FROM A) SELECT n_chunks, n_elements, nnz, CAST(nnz AS DOUBLE) / n_elements AS beta, (CAST(n_elements AS DOUBLE) / nnz - 1) * 100 AS fill_in_percent FROM M, T")
def sell_beta_fill_in(spark, sf_dir):
    return sell.to_sell(_ps(spark, sf_dir), CHUNK, SIGMA).metrics()


@query(f"WITH {SELL}, M AS (SELECT count(*) AS n_chunks, CAST(sum(len) * {CHUNK} AS BIGINT) AS n_elements FROM C) SELECT CAST(n_elements * 12 + (2 * n_chunks + 1) * 4 AS BIGINT) AS matrix_bytes, CAST({N} * 32 AS BIGINT) AS x_bytes, CAST({N} * 32 AS BIGINT) AS y_bytes FROM M")
def memory_model(spark, sf_dir):
    m = sell.to_sell(_ps(spark, sf_dir), CHUNK, SIGMA)
    return m.metrics().select(*stats.memory_model(F.col("n_elements"), F.col("n_chunks"), F.lit(m.n_rows), width=4))


@query(f"WITH {A}, P AS (SELECT CAST(unnest(range({N} + 1)) AS BIGINT) AS i), L AS (SELECT P.i, count(A.i) AS n FROM P LEFT JOIN A ON A.i = P.i GROUP BY 1) SELECT i, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM L")
def crs_row_ptrs(spark, sf_dir):
    return sell.row_pointers(_ps(spark, sf_dir))


@query(f"WITH {A}, B AS (SELECT * FROM A WHERE i >= j) SELECT i, j, v FROM B UNION ALL SELECT j, i, v FROM B WHERE i <> j")
def symmetric_expand(spark, sf_dir):
    a = _ps(spark, sf_dir, square=True)
    return scale.expand_symmetric(a.with_entries(a.entries.where("i >= j"))).entries


SQPERM = f"S AS (SELECT R.i AS i_old, row_number() OVER (ORDER BY count(A.i) DESC, R.i) - 1 AS i_new FROM R LEFT JOIN A ON A.i = R.i GROUP BY R.i)"


@query(f"WITH {A}, {RSQ}, {SQPERM} SELECT p.i_new AS i, q.i_new AS j, v FROM A JOIN S p ON p.i_old = A.i JOIN S q ON q.i_old = A.j")
def permute_rows_cols(spark, sf_dir):
    a = _ps(spark, sf_dir, square=True)
    return sell.permute(a, sell.row_permutation(a, 1, 1 << 40)).entries


@query(f"WITH {A}, {RSQ}, {SQPERM} SELECT i_old AS i, CAST(i_old % 7 + 1 AS DOUBLE) AS x FROM S")
def permute_vector_back(spark, sf_dir):
    a = _ps(spark, sf_dir, square=True)
    perm = sell.row_permutation(a, 1, 1 << 40)
    x = a.rows().withColumn("x", seven(F.col("i")))
    return sell.permute_vector(sell.permute_vector(x, perm), sell.invert(perm))


# ---- statistics


@query(f"WITH {A} SELECT min(abs(v)) AS min_abs, min(abs(v)) + (max(abs(v)) - min(abs(v))) / 2 AS midrange, max(abs(v)) AS max_abs FROM A")
def matrix_min_mid_max(spark, sf_dir):
    return stats.value_range(_ps(spark, sf_dir))


def _lines_sql(axis: str, other: str) -> str:
    return f"WITH {A} SELECT {axis}, count(*) AS n, count(*) FILTER (v <> 0) AS n_nonzero, min(v) AS min_v, max(v) AS max_v, min({other}) AS first, max({other}) AS last, CAST(1 + greatest(0, {axis} - min({other})) + greatest(0, max({other}) - {axis}) AS BIGINT) AS bandwidth FROM A GROUP BY {axis}"


@query(_lines_sql("i", "j"))
def row_stats(spark, sf_dir):
    return stats.line_stats(_ps(spark, sf_dir), "i")


@query(_lines_sql("j", "i"))
def col_stats(spark, sf_dir):
    return stats.line_stats(_ps(spark, sf_dir), "j")


@query(f"WITH {A}, {R}, L AS (SELECT R.i, count(A.i) AS n FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1) SELECT count(*) AS rows, min(n) AS shortest, max(n) AS longest, avg(n) AS average, round(stddev_pop(n), 6) AS deviation, round(stddev_pop(n) / avg(n), 6) AS cv, (SELECT n FROM L ORDER BY n LIMIT 1 OFFSET (SELECT count(*) // 2 FROM L)) AS median FROM L")
def row_length_stats(spark, sf_dir):
    d = stats.describe(sell.row_lengths(_ps(spark, sf_dir)), "n")
    return d.select(F.col("n").alias("rows"), F.col("min").alias("shortest"), F.col("max").alias("longest"), F.col("avg").alias("average"), F.round("std", 6).alias("deviation"), F.round("cv", 6).alias("cv"), "median")


@query(f"WITH {A}, {R}, L AS (SELECT R.i, count(A.i) AS n FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1) SELECT CAST(CASE WHEN n < 2 THEN n ELSE least(9 * floor(log10(n - 1)) + floor((n - 1) / power(10.0, floor(log10(n - 1)))) + 1, {stats.LAST_BUCKET}) END AS INTEGER) AS bucket, count(*) AS n FROM L GROUP BY 1")
def row_length_histogram(spark, sf_dir):
    return stats.count_histogram(sell.row_lengths(_ps(spark, sf_dir)), "n")


@query(f"WITH {A} SELECT max(greatest(0, i - j)) AS lower, max(greatest(0, j - i)) AS upper, 1 + max(greatest(0, i - j)) + max(greatest(0, j - i)) AS bandwidth FROM A")
def bandwidth(spark, sf_dir):
    return stats.bandwidth(_ps(spark, sf_dir))


@query(f"WITH {A}, {R}, L AS (SELECT R.i, count(A.i) AS n FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1), B AS (SELECT 1 + max(greatest(0, i - j)) + max(greatest(0, j - i)) AS bandwidth FROM A) SELECT {N} AS n_rows, (SELECT max(s_suppkey) + 1 FROM supplier) AS n_cols, CAST(sum(n) AS BIGINT) AS nnz, CAST(sum(n) AS DOUBLE) / ({N} * CAST((SELECT max(s_suppkey) + 1 FROM supplier) AS DOUBLE)) AS density, count(*) FILTER (n = 0) AS empty_rows, max(n) AS longest_row, (SELECT bandwidth FROM B) AS bandwidth FROM L")
def matrix_profile(spark, sf_dir):
    return stats.matrix_profile(_ps(spark, sf_dir))


@query("WITH A AS (SELECT l_extendedprice AS v FROM lineitem), E AS (SELECT min(v) AS low, max(v) AS high FROM A) SELECT CAST(least(floor((v - low) * 50 / (high - low)), 49) AS INTEGER) AS bin, count(*) AS n FROM A, E GROUP BY 1")
def value_histogram_50(spark, sf_dir):
    return stats.value_histogram(tables.parts_by_suppliers(spark, sf_dir, "l_extendedprice"))


@query(f"WITH {A} SELECT max(s) AS norm_inf, 1e-6 * max(s) / (0.5 * power(2.0, -23)) AS threshold FROM (SELECT i, sum(abs(v)) AS s FROM A GROUP BY 1)")
def inf_norm_threshold(spark, sf_dir):
    return stats.norm_threshold(_ps(spark, sf_dir), 1e-6)


@query("SELECT DISTINCT n_nationkey, n_regionkey, CAST((n_nationkey + n_regionkey) * (n_nationkey + n_regionkey + 1) // 2 + n_regionkey AS BIGINT) AS tag FROM nation")
def pair_tags(spark, sf_dir):
    return tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", cantor_pairing(F.col("n_nationkey"), F.col("n_regionkey")).alias("tag")).distinct()


# ---- scaling and precision


@query(f"WITH {A}, RM AS (SELECT i, max(abs(v)) AS m FROM A GROUP BY 1), B AS (SELECT A.i, j, v / m AS v FROM A JOIN RM ON RM.i = A.i), CM AS (SELECT j, max(abs(v)) AS m FROM B GROUP BY 1) SELECT B.i, B.j, v / m AS v FROM B JOIN CM ON CM.j = B.j")
def equilibrate(spark, sf_dir):
    return scale.equilibrate(_ps(spark, sf_dir))[0].entries.select("i", "j", "v")


@query(f"WITH {A} SELECT i, j, v FROM A WHERE abs(v) >= 40")
def dropout(spark, sf_dir):
    return scale.dropout(_ps(spark, sf_dir), 40.0).entries


@query(f"WITH {A} SELECT i, j, v, CASE WHEN abs(v) >= {THRESHOLD} THEN 'dp' ELSE 'sp' END AS prec FROM A")
def ap_partition_2way(spark, sf_dir):
    return precision.partition_precisions(_ps(spark, sf_dir), "ap[dp_sp]", THRESHOLD)


@query(f"WITH {A} SELECT i, j, v, CASE WHEN abs(v) >= 40 THEN 'dp' WHEN abs(v) >= 10 THEN 'sp' ELSE 'hp' END AS prec FROM A")
def ap_partition_3way(spark, sf_dir):
    return precision.partition_precisions(_ps(spark, sf_dir), "ap[dp_sp_hp]", 40.0, 10.0)


@query(f"WITH {A}, RM AS (SELECT i, max(abs(v)) AS m FROM A GROUP BY 1), B AS (SELECT A.i, j, v / m AS v, m AS r FROM A JOIN RM ON RM.i = A.i), CM AS (SELECT j, max(abs(v)) AS m FROM B GROUP BY 1) SELECT CASE WHEN abs(v / m) >= {THRESHOLD} / (r * m) THEN 'dp' ELSE 'sp' END AS prec, count(*) AS nnz FROM B JOIN CM ON CM.j = B.j GROUP BY 1")
def ap_partition_equilibrated(spark, sf_dir):
    a, rows, cols = scale.equilibrate(_ps(spark, sf_dir))
    return precision.bucket_sizes(precision.partition_precisions(a, "ap[dp_sp]", THRESHOLD, None, rows, cols))


def _adaptive_sql(low: str) -> str:
    high, small = f"CASE WHEN v >= {LIMIT} THEN v * {SEVEN} ELSE 0 END", f"CASE WHEN v < {LIMIT} THEN {low} ELSE 0 END"
    return f"WITH {LARGE}, {R} SELECT R.i, coalesce(sum({high}), 0.0) + coalesce(sum({small}), 0.0) AS y, coalesce(sum({high}), 0.0) AS y_dp, coalesce(sum({small}), 0.0) AS y_sp FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1"


@query(_adaptive_sql(f"CAST(CAST(v AS REAL) AS DOUBLE) * {SEVEN}"))
def spmv_ap_dp_sp(spark, sf_dir):
    a = _large(spark, sf_dir)
    return precision.spmv_adaptive(a, precision.partition_precisions(a, "ap[dp_sp]", LIMIT), seven, "ap[dp_sp]")


@query(_adaptive_sql(f"CAST(CAST(v AS REAL) AS DOUBLE) * CAST(CAST({SEVEN} AS REAL) AS DOUBLE)"))
def spmv_ap_dp_sp_x_sp(spark, sf_dir):
    a = _large(spark, sf_dir)
    return precision.spmv_adaptive(a, precision.partition_precisions(a, "ap[dp_sp]", LIMIT), seven, "ap[dp_sp]", "own")


def _adaptive_sell(a: SparseMatrix, mode: str, t1: float, t2: float | None = None, x_precision: str = "highest") -> DataFrame:
    split = precision.partition_precisions(a, mode, t1, t2)
    return sell.spmv_sell_adaptive(sell.precision_chunks(a, split, mode, CHUNK, SIGMA), seven, x_precision)


@query(_adaptive_sql(f"CAST(CAST(v AS REAL) AS DOUBLE) * {SEVEN}"))
def spmv_sell_ap_dp_sp(spark, sf_dir):
    return _adaptive_sell(_large(spark, sf_dir), "ap[dp_sp]", LIMIT)


@query(_adaptive_sql(f"CAST(CAST(v AS REAL) AS DOUBLE) * CAST(CAST({SEVEN} AS REAL) AS DOUBLE)"))
def spmv_sell_ap_dp_sp_x_sp(spark, sf_dir):
    return _adaptive_sell(_large(spark, sf_dir), "ap[dp_sp]", LIMIT, x_precision="own")


def _half(v: str) -> str:
    return f"(CASE WHEN {v} = 0 THEN 0.0 ELSE round_even({v} / power(2.0, floor(log2({v})) - 10), 0) * power(2.0, floor(log2({v})) - 10) END)"


WIDE = "A AS (SELECT l_partkey AS i, l_suppkey AS j, l_quantity * 1201 AS v FROM lineitem)"


def _wide(spark, sf_dir) -> SparseMatrix:
    """Whole values up to 60050, which a half can't all hold."""
    a = _ps(spark, sf_dir)
    return a.with_entries(a.entries.withColumn("v", F.col("v") * 1201))


def _half_sql(buckets: list[tuple[str, str, str]]) -> str:
    parts = {name: f"coalesce(sum(CASE WHEN {when} THEN {v} * {SEVEN} ELSE 0 END), 0.0)" for name, when, v in buckets}
    return f"WITH {WIDE}, {R} SELECT R.i, {' + '.join(parts.values())} AS y, {', '.join(f'{s} AS y_{n}' for n, s in parts.items())} FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1"


@query(_half_sql([("dp", "v >= 30000", "v"), ("hp", "v < 30000", _half("v"))]))
def spmv_ap_dp_hp(spark, sf_dir):
    a = _wide(spark, sf_dir)
    return precision.spmv_adaptive(a, precision.partition_precisions(a, "ap[dp_hp]", 30000.0), seven, "ap[dp_hp]")


@query(_half_sql([("sp", "v >= 30000", "CAST(CAST(v AS REAL) AS DOUBLE)"), ("hp", "v < 30000", _half("v"))]))
def spmv_ap_sp_hp(spark, sf_dir):
    a = _wide(spark, sf_dir)
    out = precision.spmv_adaptive(a, precision.partition_precisions(a, "ap[sp_hp]", 30000.0), seven, "ap[sp_hp]")
    return out.select("i", (F.col("y_sp") + F.col("y_hp")).alias("y"), "y_sp", "y_hp")


@query(_half_sql([("dp", "v >= 40000", "v"), ("sp", "v < 40000 AND v >= 20000", "CAST(CAST(v AS REAL) AS DOUBLE)"), ("hp", "v < 20000", _half("v"))]))
def spmv_ap_dp_sp_hp(spark, sf_dir):
    a = _wide(spark, sf_dir)
    return precision.spmv_adaptive(a, precision.partition_precisions(a, "ap[dp_sp_hp]", 40000.0, 20000.0), seven, "ap[dp_sp_hp]")


@query(_half_sql([("dp", "v >= 30000", "v"), ("hp", "v < 30000", _half("v"))]))
def spmv_sell_ap_dp_hp(spark, sf_dir):
    return _adaptive_sell(_wide(spark, sf_dir), "ap[dp_hp]", 30000.0)


@query(_half_sql([("dp", "v >= 40000", "v"), ("sp", "v < 40000 AND v >= 20000", "CAST(CAST(v AS REAL) AS DOUBLE)"), ("hp", "v < 20000", _half("v"))]))
def spmv_sell_ap_dp_sp_hp(spark, sf_dir):
    return _adaptive_sell(_wide(spark, sf_dir), "ap[dp_sp_hp]", 40000.0, 20000.0)


@query(f"WITH {WIDE}, {R} SELECT R.i, coalesce(sum({_half('v')} * {SEVEN}), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmv_sell_hp(spark, sf_dir):
    return sell.spmv_sell(sell.to_sell(_wide(spark, sf_dir), CHUNK, SIGMA), seven, "hp")


@query(f"WITH {WIDE}, {R} SELECT R.i, coalesce(sum({_half('v')} * {SEVEN}), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def spmv_half(spark, sf_dir):
    return spmv.spmv(_wide(spark, sf_dir), seven, "hp")


# ---- row partitions

ROWS = f"B AS (SELECT CAST(p AS INTEGER) AS part, p * ({NSQ} // {PARTS}) AS lo, CASE WHEN p = {PARTS - 1} THEN {NSQ} ELSE (p + 1) * ({NSQ} // {PARTS}) END AS hi FROM (SELECT unnest(range({PARTS})) AS p))"
PLAN = f"{A}, {ROWS}, H AS (SELECT DISTINCT p.part, q.part AS owner, A.j FROM A JOIN B p ON A.i >= p.lo AND A.i < p.hi JOIN B q ON A.j >= q.lo AND A.j < q.hi WHERE p.part <> q.part)"


def _square(spark, sf_dir) -> tuple[SparseMatrix, DataFrame]:
    a = _ps(spark, sf_dir, square=True)
    return a, partition.segment_rows(a, PARTS)


@query(f"WITH {ROWS} SELECT part, lo, hi FROM B")
def seg_rows(spark, sf_dir):
    return _square(spark, sf_dir)[1]


@query(f"WITH {A}, Q AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS g FROM A), T AS (SELECT count(*) // {PARTS} + 1 AS step FROM A), "
       f"E AS (SELECT p, CASE WHEN p = {PARTS} THEN {N} ELSE (SELECT i + 1 FROM Q, T WHERE g = p * step - 1) END AS hi FROM (SELECT unnest(range(1, {PARTS + 1})) AS p)) SELECT CAST(p - 1 AS INTEGER) AS part, coalesce(lag(hi) OVER (ORDER BY p), 0) AS lo, hi FROM E")  # fmt: skip
def seg_nnz(spark, sf_dir):
    return partition.segment_nnz(_ps(spark, sf_dir), PARTS)


@query(f"WITH {PLAN} SELECT part, owner, j FROM H")
def halo_plan(spark, sf_dir):
    return partition.halo_plan(*_square(spark, sf_dir))


@query(f"WITH {PLAN} SELECT H.part, owner, j, hi - lo + row_number() OVER (PARTITION BY H.part ORDER BY owner > H.part, owner, j) - 1 AS local FROM H JOIN B ON B.part = H.part")
def halo_numbering(spark, sf_dir):
    return partition.halo_numbering(*_square(spark, sf_dir))


@query(f"WITH {PLAN}, G AS (SELECT owner, part, count(*) AS n FROM H GROUP BY 1, 2) SELECT owner, part, n, CAST(coalesce(sum(n) OVER (PARTITION BY owner ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM G")
def send_plan(spark, sf_dir):
    return partition.send_plan(partition.halo_plan(*_square(spark, sf_dir)))


@query(f"WITH {PLAN} SELECT B.part, CAST(count(j) * 4 AS BIGINT) AS received FROM B LEFT JOIN H ON H.part = B.part GROUP BY 1")
def comm_volume(spark, sf_dir):
    return partition.communication_volume(*_square(spark, sf_dir), width=4)


@query(f"WITH {A}, {ROWS} SELECT part, hi - lo AS n_rows, count(DISTINCT i) AS n_filled, count(i) AS nnz FROM B LEFT JOIN A ON i >= lo AND i < hi GROUP BY part, hi, lo")
def row_partition_balance(spark, sf_dir):
    return partition.part_balance(*_square(spark, sf_dir))


@query(f"WITH {A}, {ROWS} SELECT part, i - lo AS i_local, j, v FROM A JOIN B ON i >= lo AND i < hi")
def local_rows(spark, sf_dir):
    return partition.local_rows(*_square(spark, sf_dir)).select("part", "i_local", "j", "v")


@query(f"SELECT CAST(p AS INTEGER) AS part, CAST(ceil((p + 1) * {NSQ} / {PARTS}.0) - ceil(p * {NSQ} / {PARTS}.0) AS BIGINT) AS n_rows FROM (SELECT unnest(range({PARTS})) AS p)")
def graph_part_sizes(spark, sf_dir):
    """Which rows share a part depends on the votes; the parts' sizes don't."""
    a = _ps(spark, sf_dir, square=True)
    return partition.graph_parts(a, PARTS, rounds=2).groupBy("part").agg(F.count("*").alias("n_rows"))


def _graph_sql(rounds: int) -> str:
    """The most frequent group among the neighbours and the row itself, the smallest of equals; then equal shares."""
    steps = ["T0 AS (SELECT i, i AS label FROM R)"]
    for k in range(1, rounds + 1):
        heard = f"SELECT L.i, label FROM L JOIN T{k - 1} t ON t.i = L.j UNION ALL SELECT i, label FROM T{k - 1}"
        steps.append(f"V{k} AS (SELECT i, label, row_number() OVER (PARTITION BY i ORDER BY count(*) DESC, label) AS place FROM ({heard}) GROUP BY i, label)")
        steps.append(f"T{k} AS (SELECT i, label FROM V{k} WHERE place = 1)")
    return f"{A}, {RSQ}, L AS (SELECT i, j FROM A WHERE i <> j UNION SELECT j, i FROM A WHERE i <> j), {', '.join(steps)}, G AS (SELECT i, CAST((row_number() OVER (ORDER BY label, i) - 1) * {PARTS} // {NSQ} AS INTEGER) AS part FROM T{rounds})"


@query(f"WITH {_graph_sql(4)} SELECT i, part FROM G")
def graph_parts(spark, sf_dir):
    return partition.graph_parts(_ps(spark, sf_dir, square=True), PARTS)


@query(f"WITH {_graph_sql(4)}, E AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM A WHERE i <> j) SELECT count(*) AS links, count(*) FILTER (p.part <> q.part) AS cut FROM E JOIN G p ON p.i = E.i JOIN G q ON q.i = E.j")
def graph_edge_cut(spark, sf_dir):
    a = _ps(spark, sf_dir, square=True)
    return partition.edge_cut(a, partition.graph_parts(a, PARTS))


# ---- orders and partitions of the graph


LINKS = "L AS (SELECT i, j FROM A WHERE i <> j UNION SELECT j, i FROM A WHERE i <> j)"


@query(f"WITH RECURSIVE {A}, {LINKS}, T(i, level) AS (SELECT 0::BIGINT, 0 UNION SELECT L.j, level + 1 FROM T JOIN L ON L.i = T.i WHERE level < 6) SELECT i, CAST(min(level) AS INTEGER) AS level FROM T GROUP BY 1")
def graph_levels(spark, sf_dir):
    """How far each row that row 0 reaches is from it; no row of these tables is six away."""
    links = ordering.links_of(_ps(spark, sf_dir, square=True))
    return ordering.levels(links, spark.range(1).select(F.col("id").alias("i"), F.col("id").alias("component"))).select("i", "level")


@query(None)
def rcm_permutation(spark, sf_dir):
    return ordering.cuthill_mckee(_ps(spark, sf_dir, square=True))


@query(None)
def rcm_bandwidth(spark, sf_dir):
    """Of parts and suppliers as given, and in the order of the search."""
    a = _ps(spark, sf_dir, square=True)
    after = sell.permute(a, ordering.cuthill_mckee(a))
    named = lambda m, when: stats.bandwidth(m).select(F.lit(when).alias("order"), "lower", "upper", "bandwidth")
    return named(a, "as given").unionByName(named(after, "reverse Cuthill-McKee"))


@query(None)
def multilevel_parts(spark, sf_dir):
    return multilevel.multilevel_parts(_ps(spark, sf_dir, square=True), PARTS)


# ---- validation


def _pair(spark, sf_dir) -> DataFrame:
    a = _ps(spark, sf_dir)
    other = a.with_entries(a.entries.where("v > 1"))
    return validate.compare(spmv.spmv(other, constant()), spmv.spmv(a, constant()))


PAIR = f"{A}, {R}, C AS (SELECT R.i, coalesce(sum(v * 5.0) FILTER (v > 1), 0.0) AS y, coalesce(sum(v * 5.0), 0.0) AS ref FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1), D AS (SELECT *, abs(ref - y) AS absolute, CASE WHEN ref = 0 THEN CASE WHEN y = 0 THEN 0.0 ELSE 'infinity'::DOUBLE END ELSE abs(ref - y) / abs(ref) END AS relative FROM C)"


@query(f"WITH {PAIR} SELECT *, CASE WHEN relative > 0.01 THEN 'ERROR' WHEN relative > 0.0001 THEN 'WARNING' ELSE 'OK' END AS verdict FROM D")
def validate_elements(spark, sf_dir):
    return _pair(spark, sf_dir)


@query(f"WITH {PAIR} SELECT count(*) AS n, count(*) FILTER (relative > 0.01) AS errors, count(*) FILTER (relative > 0.0001 AND relative <= 0.01) AS warnings, max(relative) AS max_relative, max(absolute) AS max_absolute, sqrt(sum((ref - y) * (ref - y))) AS distance, sqrt(sum(ref * ref)) AS magnitude FROM D")
def validate_norms(spark, sf_dir):
    return validate.summary(_pair(spark, sf_dir)).drop("at_relative", "at_absolute")


@query(f"WITH {PAIR} SELECT (SELECT i FROM D ORDER BY relative DESC, i LIMIT 1) AS at_relative, (SELECT i FROM D ORDER BY absolute DESC, i LIMIT 1) AS at_absolute")
def validate_worst(spark, sf_dir):
    """Where the largest differences are, the first row of equals."""
    return validate.summary(_pair(spark, sf_dir)).select("at_relative", "at_absolute")


@query(f"WITH {PAIR} SELECT count(*) FILTER (relative > 0.00001) AS mismatches, max(relative) AS max_relative FROM D")
def validate_mismatches(spark, sf_dir):
    return validate.mismatches(_pair(spark, sf_dir), 1e-5)


@query(f"WITH {LARGE}, {R} SELECT R.i, coalesce(sum(v * 5.0), 0.0) AS ref, coalesce(sum(CAST(CAST(v AS REAL) AS DOUBLE) * 5.0), 0.0) AS y FROM R LEFT JOIN A ON A.i = R.i GROUP BY 1")
def validate_single(spark, sf_dir):
    a = _large(spark, sf_dir)
    low = a.with_entries(a.entries.withColumn("v", to_single(F.col("v"))))
    return validate.compare(spmv.spmv(low, constant()), spmv.spmv(a, constant())).select("i", "ref", "y")
