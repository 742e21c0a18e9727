"""Matrix Market files, read and written by Spark's text source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import expand_symmetric
from ..plans.matrix import SparseMatrix
from ..plans.tables import ranked

#: The value of entries in files that only give places.
PATTERN_VALUE = 0.01
FIELDS = ("real", "integer", "pattern", "complex")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


@dataclass(frozen=True)
class Banner:
    format: str = "coordinate"
    field: str = "real"
    symmetry: str = "general"

    @staticmethod
    def parse(line: str) -> Banner:
        words = line.strip().lower().split()
        if len(words) != 5 or words[0] != "%%matrixmarket" or words[1] != "matrix":
            raise ValueError(f"not a Matrix Market banner: {line!r}")
        banner = Banner(*words[2:])
        banner.check()
        return banner

    def check(self) -> None:
        if self.format not in ("coordinate", "array"):
            raise ValueError(f"unknown format {self.format}")
        if self.field not in FIELDS or self.symmetry not in SYMMETRIES:
            raise ValueError(f"unknown field or symmetry: {self.field} {self.symmetry}")
        if self.format == "array" and self.field == "pattern":
            raise ValueError("an array has values")

    def __str__(self) -> str:
        return f"%%MatrixMarket matrix {self.format} {self.field} {self.symmetry}"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): at rises along the file, or along a folder's files by name.

    Spark numbers lines within a split; splits (one row each here) are put in order by
    file and offset.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("line"))
    splits = ranked(lines.select("file", "block").distinct(), [], ["file", "block"], F.col("file"), "split")
    return lines.join(splits, ["file", "block"]).select("value", (F.col("split") * F.lit(1 << 33) + F.col("line")).alias("at"))


def _header(lines: DataFrame, path: str) -> tuple[Banner, int, int, int, int]:
    """The banner, the size line's numbers and its place, in one pass."""
    comment = F.col("value").startswith("%")
    data = ~comment & (F.trim("value") != "")
    first, size, at = lines.agg(F.min_by("value", F.when(F.col("value").startswith("%%"), F.col("at"))), F.min_by("value", F.when(data, F.col("at"))), F.min(F.when(data, F.col("at")))).first()
    if first is None or size is None:
        raise ValueError(f"{path} has no banner or no size line")
    banner, numbers = Banner.parse(first), [int(x) for x in size.split()]
    if banner.format == "array":
        return banner, numbers[0], numbers[1], numbers[0] * numbers[1], at
    if len(numbers) != 3:
        raise ValueError(f"the size line must have three numbers: {size!r}")
    return banner, *numbers, at


def read_header(spark: SparkSession, path: str) -> tuple[Banner, int, int, int]:
    """The banner and the size line (rows, columns, stored entries)."""
    return _header(_lines(spark, path), path)[:4]


def read_matrix(spark: SparkSession, path: str, square: bool = True) -> SparseMatrix:
    """Entries (seq, i, j, v), 0-based. Symmetric files are expanded, each mirrored entry after
    its original; entries of pattern files are 0.01. seq is the order in the file, so that
    sorting by (i, seq) is a stable sort by row. Explicit zeros and repeated places stay."""
    lines = _lines(spark, path)
    banner, n_rows, n_cols, nnz, head = _header(lines, path)
    if banner.format != "coordinate" or banner.field == "complex" or banner.symmetry not in ("general", "symmetric"):
        raise ValueError(f"only real, integer or pattern, general or symmetric coordinate files: {banner}")
    if square and n_rows != n_cols:
        raise ValueError(f"{path} isn't square: {n_rows} x {n_cols}")
    lines = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    value = F.lit(PATTERN_VALUE) if banner.field == "pattern" else F.get(parts, F.lit(2)).cast("double")
    entries = lines.where(F.col("at") > head).select((F.col("at") * 2).alias("seq"), (F.get(parts, F.lit(0)).cast("long") - 1).alias("i"), (F.get(parts, F.lit(1)).cast("long") - 1).alias("j"), value.alias("v"))
    found, low, i_max, j_max = entries.agg(F.count("*"), F.min(F.least("i", "j")), F.max("i"), F.max("j")).first()
    if found != nnz or found and (low < 0 or i_max >= n_rows or j_max >= n_cols):
        raise ValueError(f"{path}: {found} entries within ({i_max}, {j_max}), the size line says {n_rows} {n_cols} {nnz}")
    matrix = SparseMatrix(entries, n_rows, n_cols)
    if banner.symmetry == "symmetric":
        lower = F.when(F.col("__lead"), F.col("seq")).otherwise(F.col("seq") + 1)
        marked = matrix.with_entries(entries.withColumn("__i", F.col("i")))
        both = expand_symmetric(marked).entries.withColumn("__lead", (F.col("i") == F.col("__i")))
        matrix = matrix.with_entries(both.withColumn("seq", lower).select("seq", "i", "j", "v"))
    return matrix


def write_matrix(a: SparseMatrix, path: str, field: str = "real", comment: str = "") -> None:
    """A folder of text parts that, in order of name, are one file: the header stands in the first.

    Numbers have 16 digits. read_matrix reads the folder.
    """
    value = F.format_string("%.16g", F.col("v").cast("double")) if field == "real" else F.col("v").cast("long").cast("string")
    line = F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *([] if field == "pattern" else [value]))
    nnz = a.entries.count()
    head = [str(Banner(field=field)), *(f"% {x}" for x in comment.splitlines()), f"{a.n_rows} {a.n_cols} {nnz}"]
    body = a.entries.select(F.lit(1).alias("body"), "i", *[F.col(c).alias(f"o_{c}") for c in a.order], line.alias("value"))
    first = a.spark.createDataFrame([("\n".join(head),)], "value string").select(F.lit(0).alias("body"), F.lit(0).cast("long").alias("i"), *[F.lit(None).cast(a.entries.schema[c].dataType).alias(f"o_{c}") for c in a.order], "value")
    rows = first.unionByName(body)
    order = ["body", "i", *[f"o_{c}" for c in a.order]]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
