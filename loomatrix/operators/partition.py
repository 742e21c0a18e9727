"""Row partitions, and which vector elements each part needs from others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.matrix import SparseMatrix
from ..plans.tables import bucket_width, dealt, ranked, running_sum, written
from .ordering import links_of
from .sell import permute, row_lengths

#: Boundaries are a table that is broadcast; more parts than this are refused.
MOST_PARTS = 100_000


def _checked(parts: int) -> None:
    if not 1 <= parts <= MOST_PARTS:
        raise ValueError(f"parts must be from 1 to {MOST_PARTS}")


def _boundaries(a: SparseMatrix, ends: list[int]) -> DataFrame:
    """(part, lo, hi) from the parts' ends; if the last part is empty, inner boundaries move down by one."""
    if len(ends) > 1 and ends[-1] <= ends[-2]:
        ends = [*(max(0, e - 1) for e in ends[:-1]), ends[-1]]
    if any(x > y for x, y in zip([0, *ends], ends, strict=False)):
        raise ValueError("boundaries must not fall: too many parts for this matrix")
    rows = [(k, lo, hi) for k, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False))]
    return a.spark.createDataFrame(rows, "part int, lo bigint, hi bigint").coalesce(1)


def segment_rows(a: SparseMatrix, parts: int) -> DataFrame:
    """Equal numbers of rows: boundaries at multiples of n div parts, the last part takes the rest."""
    _checked(parts)
    step = a.n_rows // parts
    return _boundaries(a, [step * (k + 1) for k in range(parts - 1)] + [a.n_rows])


def segment_nnz(a: SparseMatrix, parts: int) -> DataFrame:
    """Equal numbers of entries: with q = nnz div parts, cut k follows the row of entry k (q + 1) - 1.

    Entries are counted along rows; only row lengths are summed up, never all entries.
    """
    _checked(parts)
    rows = running_sum(row_lengths(a), "i", F.col("n"), a.n_rows, "ahead")
    nnz = a.entries.count()
    step = nnz // parts + 1
    # entry number k * step - 1 lies in the row with ahead < k * step <= ahead + n
    first, last = F.expr(f"ahead div {step}") + 1, F.expr(f"(ahead + n) div {step}")
    cuts = rows.where(last >= first).select(F.explode(F.sequence(first, last)).alias("k"), (F.col("i") + 1).alias("end")).where(F.col("k") < parts)
    found = {k: end for k, end in cuts.collect()}  # fewer than `parts` rows
    ends = [found.get(k, a.n_rows) for k in range(1, parts)] + [a.n_rows]
    return _boundaries(a, ends)


def _with_part(df: DataFrame, column: str, bounds: DataFrame, width: int, into: str) -> DataFrame:
    """Adds the part whose range holds column. The range join is an equi-join on coarse ranges first."""
    pieces = bounds.where("hi > lo").select(F.col("part").alias(into), "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("__w"))
    met = df.withColumn("__w", F.expr(f"`{column}` div {width}")).join(pieces, "__w")
    return met.where((F.col(column) >= F.col("lo")) & (F.col(column) < F.col("hi"))).drop("__w", "lo", "hi")


def assign_parts(a: SparseMatrix, bounds: DataFrame) -> DataFrame:
    """The entries with the part of their row and the owner of their column."""
    width = max(1, a.n_rows // max(1, min(MOST_PARTS, 8 * bounds.count())))
    return _with_part(_with_part(a.entries, "i", bounds, width, "part"), "j", bounds, width, "owner")


def local_rows(a: SparseMatrix, bounds: DataFrame) -> DataFrame:
    """The entries with their row number inside their part."""
    width = max(1, a.n_rows // max(1, 8 * bounds.count()))
    owned = _with_part(a.entries, "i", bounds, width, "part")
    return owned.join(bounds.select("part", "lo"), "part").withColumn("i_local", F.col("i") - F.col("lo")).drop("lo")


def halo_plan(a: SparseMatrix, bounds: DataFrame) -> DataFrame:
    """(part, owner, j): the columns that each part needs from others, each once."""
    return assign_parts(a, bounds).where("owner <> part").select("part", "owner", "j").distinct()


def halo_numbering(a: SparseMatrix, bounds: DataFrame) -> DataFrame:
    """(part, owner, j, local): remote columns are numbered after a part's own rows, those of
    owners on the left first, then by owner and column."""
    plan = halo_plan(a, bounds).join(bounds.select("part", (F.col("hi") - F.col("lo")).alias("own")), "part").withColumn("right", (F.col("owner") > F.col("part")).cast("int"))
    # the columns of one owner are ranked apart, then the owners' counts are added up
    place = ranked(plan, ["part"], ["j"], F.col("right") * F.lit(1 << 40) + F.col("owner"), "rank")
    return place.select("part", "owner", "j", (F.col("own") + F.col("rank")).alias("local"))


def send_plan(plan: DataFrame) -> DataFrame:
    """(owner, part, n, before): the elements that each owner sends to each part and where they begin."""
    counts = plan.groupBy("owner", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("owner").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0)).cast("long"))


def communication_volume(a: SparseMatrix, bounds: DataFrame, width: int = 1) -> DataFrame:
    """(part, received): vector elements each part receives for one product with `width` vectors."""
    counts = halo_plan(a, bounds).groupBy("part").agg(F.count("*").alias("c"))
    return bounds.select("part").join(counts, "part", "left").select("part", (F.coalesce("c", F.lit(0)) * width).cast("long").alias("received"))


def part_balance(a: SparseMatrix, bounds: DataFrame) -> DataFrame:
    """(part, n_rows, n_filled, nnz) of each part."""
    width = max(1, a.n_rows // max(1, 8 * bounds.count()))
    by_row = _with_part(a.entries.groupBy("i").agg(F.count("*").alias("n")), "i", bounds, width, "part")
    counts = by_row.groupBy("part").agg(F.count("*").alias("n_filled"), F.sum("n").alias("nnz"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return bounds.join(counts, "part", "left").select("part", (F.col("hi") - F.col("lo")).alias("n_rows"), zero("n_filled"), zero("nnz"))


def graph_parts(a: SparseMatrix, parts: int, rounds: int = 4) -> DataFrame:
    """(i, part): parts of near-equal size whose rows tend to share columns.

    Rows begin as groups of their own and take the group most frequent among their
    neighbours and themselves (ties: the smallest), a few times; then rows in order of
    their groups are cut into equal shares.
    """
    _checked(parts)
    if not a.square:
        raise ValueError("graph parts need a square matrix")
    links = links_of(a)
    n_heard = links.count() + a.n_rows
    labels = a.rows().withColumn("label", F.col("i"))
    for _ in range(rounds):
        heard = links.join(labels.select(F.col("i").alias("j"), "label"), "j").select("i", "label").unionByName(labels)
        # most votes are for groups of their own at first, so they are dealt out before they are counted
        votes = dealt(heard, n_heard, "i", "label").groupBy("i", "label").agg(F.count("*").alias("n"))
        labels = written(votes.groupBy("i").agg(F.max(F.struct("n", (-F.col("label")).alias("label"))).alias("b")).select("i", (-F.col("b.label")).alias("label")))
    sizes = running_sum(labels.groupBy("label").agg(F.count("*").alias("n")), "label", F.col("n"), a.n_rows, "ahead").select("label", "ahead")
    placed = ranked(labels, ["label"], ["i"], F.expr(f"i div {bucket_width(a.n_rows)}"), "among").join(sizes, "label")
    return placed.select("i", F.expr(f"cast((ahead + among) * {parts} div {max(1, a.n_rows)} as int)").alias("part"))


def edge_cut(a: SparseMatrix, parts: DataFrame) -> DataFrame:
    """One row (links, cut): pairs of different rows that an entry links, and those in different parts."""
    links = a.entries.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    links = dealt(links, a.entries.count(), "i", "j").distinct()
    of = lambda end: parts.select(F.col("i").alias(end), F.col("part").alias(f"part_{end}"))
    met = links.join(of("i"), "i").join(of("j"), "j")
    return met.agg(F.count("*").alias("links"), F.count_if(F.col("part_i") != F.col("part_j")).alias("cut"))


def deal_parts(a: SparseMatrix, parts: int, segmentation: str = "rows") -> SparseMatrix:
    """The matrix with each part's entries in one partition: parts of equal rows, of equal
    entries (nnz), or of rows that share columns (graph)."""
    if segmentation == "graph":
        owned = a.entries.join(graph_parts(a, parts), "i")
    else:
        bounds = (segment_nnz if segmentation == "nnz" else segment_rows)(a, parts)
        owned = _with_part(a.entries, "i", bounds, max(1, a.n_rows // max(1, 8 * parts)), "part")
    return a.with_entries(owned.repartition(parts, "part").select(*a.entries.columns))


def by_parts(a: SparseMatrix, parts: DataFrame) -> tuple[SparseMatrix, DataFrame]:
    """The matrix with rows and columns ordered by (part, i), and the permutation used."""
    width = bucket_width(a.n_rows)
    placed = ranked(parts, [], ["part", "i"], F.col("part").cast("long") * (a.n_rows // width + 1) + F.expr(f"i div {width}"), "i_new")
    perm = placed.select(F.col("i").alias("i_old"), "i_new")
    return permute(a, perm), perm


def deal(a: SparseMatrix, partitions: int) -> SparseMatrix:
    """Entries dealt to partitions by ranges of rows."""
    return a.with_entries(a.entries.repartitionByRange(partitions, "i"))
