"""Stored chunk format: a matrix laid out once, read by many products.

A folder holds

* `tiles`: the packed chunks with the rows they stem from, dealt to directories by ranges
  of chunks and sorted, with the least and largest row and column of each tile;
* `rows`: the permutation, (i_old, i_new, n);
* `manifest`: one row with C, sigma, the sizes, and how many chunks a directory has.

Rows move inside their block of sigma rows only, so a range of rows is a range of chunks:
a product over some rows reads their directories, and Parquet's statistics skip what
holds none of the rows or columns wanted. No product shuffles the matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sell import TILE_LANES, SellMatrix, pack_chunks, unpack_chunks
from ..operators.spmv import CASTS
from ..plans.matrix import SparseMatrix, Vector, meet

#: Padded elements that a directory has room for, about.
PART_ELEMENTS = 1 << 24


def store(m: SellMatrix, path: str, part_elements: int = PART_ELEMENTS, by_blocks: bool = True) -> StoredMatrix:
    """Writes a chunk layout; by_blocks says that rows moved inside their blocks of sigma rows
    only, as they do unless to_sell was given a permutation."""
    spark = m.perm.sparkSession
    lanes = min(m.chunk, TILE_LANES)
    m.perm.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    at = rows.select("i_old", "n", F.expr(f"i_new div {m.chunk}").alias("c"), F.expr(f"i_new % {m.chunk}").alias("lane"))
    owners = at.groupBy("c", F.expr(f"lane div {lanes}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("lane", "i_old", "n"))).alias("o"))  # TILE_LANES at most
    sizes = m.chunks.agg(F.count("*").alias("n"), (F.sum("len") * m.chunk).alias("elements")).first()
    n_chunks, elements = sizes.n, sizes.elements or 0
    each = max(1, n_chunks * part_elements // max(1, elements))
    # padding has column 0 and no entry of its own; the tile's real columns are told by lane and place
    tiles = pack_chunks(m).join(owners, ["c", "part"])
    rows_of, counts = F.transform("o", lambda o: o["i_old"]), F.transform("o", lambda o: o["n"])
    filled = F.filter(F.transform("cols", lambda j, p: F.when(F.get("counts", (p % F.col("wide")).cast("int")) > F.col("first") + F.floor(p / F.col("wide")), j)), lambda j: j.isNotNull())
    places = max(1, (1 << 16) // lanes)
    tiles = tiles.withColumns({"rows": rows_of, "counts": counts, "first": F.col("segment") * places}).drop("o").withColumn("real", filled)
    tiles = tiles.withColumns({"j_min": F.array_min("real"), "j_max": F.array_max("real"), "i_min": F.array_min("rows"), "i_max": F.array_max("rows"), "nnz": F.size("real").cast("long")}).drop("real", "first")
    tiles = tiles.withColumn("dir", F.expr(f"c div {each}")).repartition("dir", "segment").sortWithinPartitions("dir", "c", "part", "segment")
    tiles.write.option("compression", "zstd").partitionBy("dir").parquet(f"{path}/tiles")
    nnz = m.perm.agg(F.sum("n")).first()[0] or 0
    row = (m.chunk, m.sigma, m.n_rows, m.n_cols, n_chunks, elements, nnz, each, by_blocks)
    spark.createDataFrame([row], "chunk bigint, sigma bigint, n_rows bigint, n_cols bigint, n_chunks bigint, n_elements bigint, nnz bigint, chunks_a_dir bigint, by_blocks boolean").coalesce(1).write.json(f"{path}/manifest")
    return open_stored(spark, path)


def open_stored(spark: SparkSession, path: str) -> StoredMatrix:
    schema = "chunk bigint, sigma bigint, n_rows bigint, n_cols bigint, n_chunks bigint, n_elements bigint, nnz bigint, chunks_a_dir bigint, by_blocks boolean"
    found = spark.read.schema(schema).json(f"{path}/manifest").first()
    return StoredMatrix(spark, path, **found.asDict())


@dataclass(frozen=True)
class StoredMatrix:
    spark: SparkSession
    path: str
    chunk: int
    sigma: int
    n_rows: int
    n_cols: int
    n_chunks: int
    n_elements: int
    nnz: int
    chunks_a_dir: int
    by_blocks: bool

    def permutation(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def tiles(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        """The tiles that may hold entries of these rows and columns (from the first to before the last)."""
        schema = "c bigint, part bigint, segment bigint, len bigint, ptr bigint, wide bigint, tall bigint, cols array<bigint>, vals array<double>, rows array<bigint>, counts array<bigint>, j_min bigint, j_max bigint, i_min bigint, i_max bigint, nnz bigint, dir bigint"
        some = self.spark.read.schema(schema).parquet(f"{self.path}/tiles")
        if rows is not None:
            lo, hi = max(0, rows[0]), min(self.n_rows, rows[1])
            if self.by_blocks:
                first, last = lo // self.sigma * self.sigma // self.chunk, -(-hi // self.sigma) * self.sigma // self.chunk
                some = some.where(F.col("c").between(first, last) & F.col("dir").between(first // self.chunks_a_dir, last // self.chunks_a_dir))
            some = some.where((F.col("i_max") >= lo) & (F.col("i_min") < hi))
        if cols is not None:
            some = some.where((F.col("j_max") >= cols[0]) & (F.col("j_min") < cols[1]))
        return some

    def entries(self, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        """(seq, i, j, v) without padding, of these rows and columns."""
        each = unpack_chunks(self.tiles(rows, cols), self.chunk, "rows", "counts")
        at = (F.col("lane") % min(self.chunk, TILE_LANES)).cast("int")
        some = each.where(F.col("k") < F.get("counts", at)).select(F.col("k").alias("seq"), F.get("rows", at).alias("i"), "j", "v")
        for name, wanted in (("i", rows), ("j", cols)):
            if wanted is not None:
                some = some.where((F.col(name) >= wanted[0]) & (F.col(name) < wanted[1]))
        return some

    def matrix(self) -> SparseMatrix:
        return SparseMatrix(self.entries(), self.n_rows, self.n_cols)

    def product(self, x: Vector, precision: str = "dp", rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
        """A x as (i, y) of all rows or some, 0.0 where there is no entry; with cols x counts as 0 elsewhere.

        The matrix isn't shuffled: tasks add up their tiles' rows, and one exchange of
        such sums follows.
        """
        cast = CASTS[precision]
        products = meet(self.entries(rows, cols).select("i", "j", "v"), x).select("i", (cast(F.col("v")) * cast(F.col("x"))).alias("y"))
        lo, hi = (0, self.n_rows) if rows is None else (max(0, rows[0]), min(self.n_rows, rows[1]))
        zeros = self.spark.range(lo, max(lo, hi)).select(F.col("id").alias("i"), F.lit(0.0).alias("y"))
        return products.unionByName(zeros).groupBy("i").agg(F.sum("y").alias("y"))
