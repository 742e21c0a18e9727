"""Storage formats: compressed rows and sorted, padded row chunks (SELL-C-sigma).

A format is a physical layout; it never changes a product. Rows are sorted by length in
blocks of sigma rows, cut into chunks of C rows, and each chunk is padded to its longest
row and stored column by column. C = n is ELL, sigma = 1 keeps the row order, C = sigma
= 1 is compressed rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix, Vector, meet, over_domain
from ..plans.tables import bucket_width, ranked, running_sum, written
from .precision import BUCKETS, STORED
from .spmv import CASTS

#: Blocks of more rows are ranked in two steps instead of one window.
ONE_WINDOW_ROWS = 1 << 16
#: Elements of one array of a packed chunk, and its lanes, at most.
TILE, TILE_LANES = 1 << 16, 1 << 10


def row_lengths(a: SparseMatrix, padded_to: int = 1) -> DataFrame:
    """(i, n) for all rows, also those that only pad the last chunk."""
    n = -(-a.n_rows // padded_to) * padded_to
    zeros = a.spark.range(n).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("n"))
    return a.entries.groupBy("i").agg(F.count("*").alias("n")).unionByName(zeros).groupBy("i").agg(F.sum("n").alias("n"))


def row_pointers(a: SparseMatrix) -> DataFrame:
    """(i, ptr) for i from 0 to n_rows: entries before row i."""
    more = row_lengths(a).unionByName(a.spark.range(1).select(F.lit(a.n_rows).cast("long").alias("i"), F.lit(0).cast("long").alias("n")))
    return running_sum(more, "i", F.col("n"), a.n_rows + 1, "ptr").select("i", F.col("ptr").cast("long").alias("ptr"))


def row_permutation(a: SparseMatrix, chunk: int, sigma: int, keys: list[str] | None = None, buckets: tuple[str, ...] = ()) -> DataFrame:
    """(i_old, i_new, n): rows by falling length in each block of sigma rows, ties by row; with keys,
    a permutation for each of their values, which `buckets` lists."""
    keys = keys or []
    rows = row_lengths(a, chunk) if not keys else _keyed_lengths(a, chunk, keys[0], buckets)
    rows = rows.withColumn("block", F.expr(f"i div {sigma}"))
    if sigma <= ONE_WINDOW_ROWS:
        rank = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(F.desc("n"), "i")) - 1
        rows = rows.withColumn("rank", rank)
    else:
        # rows of equal length are ranked by row, after the number of longer rows in the block
        same = ranked(rows, [*keys, "block", "n"], ["i"], F.expr(f"i div {bucket_width(a.n_rows)}"), "among")
        longer = rows.groupBy(*keys, "block", "n").agg(F.count("*").alias("c"))
        longer = longer.withColumn("ahead", F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "block").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
        rows = same.join(longer, [*keys, "block", "n"]).withColumn("rank", F.col("ahead") + F.col("among"))
    return rows.select(*keys, F.col("i").alias("i_old"), (F.col("block") * sigma + F.col("rank")).cast("long").alias("i_new"), "n")


def _keyed_lengths(a: SparseMatrix, padded_to: int, key: str, values: tuple[str, ...]) -> DataFrame:
    """(key, i, n) for all rows and all values of the key."""
    n = -(-a.n_rows // padded_to) * padded_to
    zeros = a.spark.range(n).select(F.explode(F.array(*map(F.lit, values))).alias(key), F.col("id").alias("i"), F.lit(0).cast("long").alias("n"))
    return a.entries.groupBy(key, "i").agg(F.count("*").alias("n")).unionByName(zeros).groupBy(key, "i").agg(F.sum("n").alias("n"))


def chunk_table(perm: DataFrame, chunk: int, n_rows: int, keys: list[str] | None = None) -> DataFrame:
    """(c, len, ptr): each chunk's width and the place of its first element."""
    keys = keys or []
    lens = perm.groupBy(*keys, F.expr(f"i_new div {chunk}").alias("c")).agg(F.max("n").alias("len"))
    return running_sum(lens, "c", F.col("len") * chunk, -(-n_rows // chunk), "ptr", tuple(keys)).select(*keys, "c", "len", F.col("ptr").cast("long").alias("ptr"))


@dataclass(frozen=True)
class SellMatrix:
    """cells (i, c, k, lane, j, v): entries in chunk c at place k of their row, whose number was i before
    rows moved; perm (i_old, i_new, n) and chunks (c, len, ptr) for those who need them. A matrix of
    several precisions has a layout for each bucket in one table, with their names in `prec`."""

    perm: DataFrame
    chunks: DataFrame
    cells: DataFrame
    n_rows: int
    n_cols: int
    chunk: int
    sigma: int
    buckets: tuple[str, ...] = ()

    @property
    def n_padded(self) -> int:
        return -(-self.n_rows // self.chunk) * self.chunk

    @property
    def elems(self) -> DataFrame:
        """(idx, c, k, lane, j, v): each element's place in the padded arrays."""
        keys = self.key_columns
        at = F.col("ptr") + F.col("k") * self.chunk + F.col("lane")
        return self.cells.join(self.chunks.select(*keys, "c", "ptr"), [*keys, "c"]).select(*keys, at.alias("idx"), "c", "k", "lane", "j", "v")

    @property
    def key_columns(self) -> list[str]:
        return ["prec"] if self.buckets else []

    def metrics(self) -> DataFrame:
        """One row: n_chunks, n_elements with padding, nnz, beta, fill_in_percent, bytes."""
        sizes = self.chunks.agg(F.count("*").alias("n_chunks"), (F.sum("len") * self.chunk).cast("long").alias("n_elements"))
        nnz = self.perm.agg(F.sum("n").cast("long").alias("nnz"))
        both = sizes.crossJoin(nnz)  # one row each
        beta = F.try_divide(F.col("nnz").cast("double"), F.col("n_elements").cast("double"))
        fill = (F.try_divide(F.col("n_elements").cast("double"), F.col("nnz").cast("double")) - 1) * 100
        return both.select("n_chunks", "n_elements", "nnz", beta.alias("beta"), fill.alias("fill_in_percent"))


def _cells(a: SparseMatrix, chunk: int, sigma: int, perm: DataFrame | None, keys: list[str], buckets: tuple[str, ...] = ()) -> DataFrame:
    """Entries with their chunk, lane and place in the row; they move once.

    What their place depends on is settled on the counts of (row, near columns): the
    counts before in the row, and the row's rank in its block of sigma rows, for which
    rows without entries don't matter, since they come last.
    """
    coarse = F.expr(f"seq div {1 << 16}") if "seq" in a.entries.columns else F.expr(f"j div {bucket_width(a.n_cols)}")
    entries = a.entries.withColumn("__c", coarse)
    counts = entries.groupBy(*keys, "i", "__c").agg(F.count("*").alias("__t"))
    if perm is None and sigma <= ONE_WINDOW_ROWS:
        counts = counts.withColumn("__b", F.expr(f"i div {sigma}"))
        group = [*keys, "__b", "i"]  # rows of one block in one place, for both windows
        counts = counts.repartition(*keys, "__b")
    else:
        group = [*keys, "i"]
    row = Window.partitionBy(*group)
    counts = counts.withColumn("__o", F.coalesce(F.sum("__t").over(row.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if perm is None and sigma <= ONE_WINDOW_ROWS:
        counts = counts.withColumn("__n", F.sum("__t").over(row))
        rank = F.dense_rank().over(Window.partitionBy(*keys, "__b").orderBy(F.desc("__n"), "i")) - 1
        counts = counts.withColumn("i_new", F.col("__b") * sigma + rank)
    else:
        if perm is None:
            perm = row_permutation(a, chunk, sigma, keys, buckets)
        counts = counts.join(perm.select(*keys, F.col("i_old").alias("i"), "i_new"), [*keys, "i"])
    fine = Window.partitionBy(*keys, "i", "__c").orderBy(*a.order)
    placed = entries.withColumn("__r", F.row_number().over(fine) - 1).join(counts.select(*keys, "i", "__c", "__o", "i_new"), [*keys, "i", "__c"])
    return placed.select(*keys, "i", F.expr(f"i_new div {chunk}").alias("c"), (F.col("__o") + F.col("__r")).cast("long").alias("k"), F.expr(f"i_new % {chunk}").alias("lane"), "j", "v")


def to_sell(a: SparseMatrix, chunk: int, sigma: int, perm: DataFrame | None = None) -> SellMatrix:
    """Converts entries to SELL-C-sigma; with perm (i_old, i_new) rows follow that instead of sorting."""
    cells = _cells(a, chunk, sigma, perm, [])
    if perm is None:
        perm = row_permutation(a, chunk, sigma)
    elif "n" not in perm.columns:
        perm = row_lengths(a, chunk).withColumnRenamed("i", "i_old").join(perm, "i_old")
    return SellMatrix(perm, chunk_table(perm, chunk, a.n_rows), cells, a.n_rows, a.n_cols, chunk, sigma)


def from_sell(m: SellMatrix) -> SparseMatrix:
    """Back to entries: padding rows have none, rows are un-permuted; seq is the place in the row."""
    return SparseMatrix(m.cells.select(F.col("k").alias("seq"), "i", "j", "v"), m.n_rows, m.n_cols)


def spmv_sell(m: SellMatrix, x: Vector, precision: str = "dp") -> DataFrame:
    """A x from the chunk layout: (i, y). sp and hp round the elements and the vector; sums are in double."""
    cast = CASTS[precision]
    products = meet(m.cells, x).select("i", (cast(F.col("v")) * cast(F.col("x"))).alias("y"))
    return over_domain(products, m.n_rows, "i", ["y"])


def spmmv_sell(m: SellMatrix, xs: DataFrame, width: int, precision: str = "dp") -> DataFrame:
    """A X from the chunk layout with X as (i, xs array): (i, ys). Each element meets its row of X once."""
    cast, names = CASTS[precision], [f"y{k}" for k in range(width)]
    met = m.cells.join(xs.select(F.col("i").alias("j"), "xs"), "j")
    products = met.select("i", *[(cast(F.col("v")) * cast(F.get("xs", F.lit(k)))).alias(n) for k, n in enumerate(names)])
    return over_domain(products, m.n_rows, "i", names).select("i", F.array(*names).alias("ys"))


def precision_chunks(a: SparseMatrix, split: DataFrame, mode: str, chunk: int, sigma: int) -> SellMatrix:
    """Chunk layouts of all buckets of entries (with their bucket in `prec`), each sorted by its own
    row lengths, in one pass: the bucket is part of every key."""
    b = a.with_entries(split)
    perm = row_permutation(b, chunk, sigma, ["prec"], BUCKETS[mode])
    return SellMatrix(perm, chunk_table(perm, chunk, a.n_rows, ["prec"]), _cells(b, chunk, sigma, None, ["prec"], BUCKETS[mode]), a.n_rows, a.n_cols, chunk, sigma, BUCKETS[mode])


def spmv_sell_adaptive(m: SellMatrix, x: Vector, x_precision: str = "highest") -> DataFrame:
    """(i, y, and y_<bucket> for each bucket): every bucket from its own layout, in its own precision.

    x_precision is as in spmv_adaptive: all buckets multiply by x in the highest one's
    precision, or each in its own.
    """
    names = m.buckets
    term = lambda name: STORED[name](F.col("v")) * STORED[names[0] if x_precision == "highest" else name](F.col("x"))
    products = meet(m.cells, x).select("i", *[F.when(F.col("prec") == name, term(name)).otherwise(0.0).alias(f"y_{name}") for name in names])
    summed = over_domain(products, m.n_rows, "i", [f"y_{n}" for n in names])
    total = sum((F.col(f"y_{n}") for n in names[1:]), F.col(f"y_{names[0]}"))
    return summed.select("i", (STORED["sp"](total) if names[0] == "sp" else total).alias("y"), *[f"y_{n}" for n in names])


def pack_rows(a: SparseMatrix) -> DataFrame:
    """Compressed rows: (i, segment, cols, vals) in entry order, for rows with entries.

    A long row has several segments, of entries near each other, so that neither an array
    nor a task has to hold all of it.
    """
    near = F.expr(f"seq div {1 << 16}") if "seq" in a.entries.columns else F.expr(f"j div {max(1 << 12, bucket_width(a.n_cols))}")
    some = a.entries.withColumn("segment", near).groupBy("i", "segment").agg(F.array_sort(F.collect_list(F.struct(*a.order, F.col("j").alias("cj"), F.col("v").alias("cv")))).alias("s"))
    return some.select("i", "segment", F.transform("s", lambda e: e["cj"]).alias("cols"), F.transform("s", lambda e: e["cv"]).alias("vals"))


def unpack_rows(packed: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
    each = packed.select("i", "segment", F.posexplode(F.arrays_zip("cols", "vals")).alias("at", "e"))
    return SparseMatrix(each.select((F.col("segment") * F.lit(1 << 32) + F.col("at")).alias("seq"), "i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v")), n_rows, n_cols)


def spmv_rows(packed: DataFrame, n_rows: int, x: Vector) -> DataFrame:
    """A x from compressed rows: (i, y). A vector given as an expression is met inside the arrays."""
    if callable(x) and not isinstance(x, DataFrame):
        terms = F.zip_with("cols", "vals", lambda j, v: v * x(j))
        products = packed.select("i", F.aggregate(terms, F.lit(0.0), lambda a, t: a + t).alias("y"))
    else:
        each = packed.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))
        products = meet(each, x).select("i", (F.col("v") * F.col("x")).alias("y"))
    return over_domain(products, n_rows, "i", ["y"])


def pack_chunks(m: SellMatrix) -> DataFrame:
    """The chunks' arrays with padding (column 0, value 0), in tiles: (c, part, segment, len, ptr, wide, tall, cols, vals).

    A tile has `wide` lanes and `tall` places of them, column by column, TILE elements at
    most: neither a chunk of very many rows nor one with a very long row has to stand in
    one array. Tiles without elements, of chunks of any length, aren't there.
    """
    lanes, places = min(m.chunk, TILE_LANES), max(1, TILE // min(m.chunk, TILE_LANES))
    wide = F.least(F.lit(lanes), m.chunk - F.col("part") * lanes)
    cells = m.cells.withColumn("part", F.expr(f"lane div {lanes}")).withColumn("segment", F.expr(f"k div {places}"))
    place = F.struct(((F.col("k") % places) * wide + F.col("lane") % lanes).alias("p"), "j", "v")
    some = cells.groupBy("c", "part", "segment").agg(F.array_sort(F.collect_list(place)).alias("s"))  # TILE elements at most
    joined = m.chunks.join(some, "c").withColumn("wide", wide).withColumn("tall", F.least(F.lit(places), F.col("len") - F.col("segment") * places))
    before = lambda k: F.coalesce(F.get("s", k - 1)["p"], F.lit(-1))

    def padded(field: str, zero):
        filled = F.flatten(F.transform("s", lambda e, k: F.concat(F.array_repeat(zero, (e["p"] - before(k) - 1).cast("int")), F.array(e[field]))))
        rest = F.array_repeat(zero, (F.col("wide") * F.col("tall") - F.element_at("s", -1)["p"] - 1).cast("int"))
        return F.concat(filled, rest)

    return joined.select("c", "part", "segment", "len", "ptr", "wide", "tall", padded("j", F.lit(0).cast("long")).alias("cols"), padded("v", F.lit(0.0)).alias("vals"))


def unpack_chunks(tiles: DataFrame, chunk: int, *kept: str) -> DataFrame:
    """(c, k, lane, j, v, and the kept columns) of all elements of tiles, padding included, by position."""
    lanes, places = min(chunk, TILE_LANES), max(1, TILE // min(chunk, TILE_LANES))
    each = tiles.select("c", "part", "segment", "wide", *kept, F.posexplode(F.arrays_zip("cols", "vals")).alias("p", "e"))
    k, lane = F.col("segment") * places + F.expr("p div wide"), F.col("part") * lanes + F.expr("p % wide")
    return each.select("c", k.alias("k"), lane.alias("lane"), F.col("e.cols").alias("j"), F.col("e.vals").alias("v"), *kept)


def spmv_packed(packed: DataFrame, m: SellMatrix, x: Vector) -> DataFrame:
    """A x from packed chunks: elements come out of the arrays by position, padding included."""
    rows = m.perm.select(F.col("i_old").alias("i"), F.expr(f"i_new div {m.chunk}").alias("c"), F.expr(f"i_new % {m.chunk}").alias("lane"))
    products = meet(unpack_chunks(packed, m.chunk), x).groupBy("c", "lane").agg(F.sum(F.col("v") * F.col("x")).alias("y")).join(rows, ["c", "lane"])
    return over_domain(products.where(F.col("i") < m.n_rows), m.n_rows, "i", ["y"])


def invert(perm: DataFrame) -> DataFrame:
    """The permutation that undoes perm."""
    return perm.select(F.col("i_new").alias("i_old"), F.col("i_old").alias("i_new"))


def permute_vector(x: DataFrame, perm: DataFrame) -> DataFrame:
    """The value at i_old goes to i_new; other columns (a block's vec) stay."""
    rest = [c for c in x.columns if c != "i"]
    return x.join(perm.select(F.col("i_old").alias("i"), "i_new"), "i").select(F.col("i_new").alias("i"), *rest)


def permute_columns(entries: DataFrame, perm: DataFrame, n_rows: int) -> DataFrame:
    """Columns below n_rows are renamed; remote columns beyond stay."""
    renamed = entries.join(perm.where(F.col("i_old") < n_rows).select(F.col("i_old").alias("j"), F.col("i_new").alias("__j")), "j", "left")
    return renamed.withColumn("j", F.coalesce("__j", "j")).drop("__j").select(*entries.columns)


def permute(a: SparseMatrix, perm: DataFrame) -> SparseMatrix:
    """P A P': rows and columns by the same permutation, which is written once for both."""
    perm = written(perm.select("i_old", "i_new"))
    rows = a.entries.join(perm.select(F.col("i_old").alias("i"), F.col("i_new").alias("__i")), "i").withColumn("i", F.col("__i")).drop("__i").select(*a.entries.columns)
    return a.with_entries(permute_columns(rows, perm, a.n_rows))
