"""Matrix Market coordinate files as a Spark data source: spark.read.format("mtx").

Register it with register(spark). A file is read in byte ranges of `split` bytes, so one
large file is read by many tasks; a line belongs to the range that its first byte lies
in. Columns are (seq, i, j, v), 0-based; seq rises along the file, or along a folder's files
in order of their names, and a symmetric file's mirrored entries follow their originals.
Writing makes such a folder: tasks write files of their own, and the commit names them in
the tasks' order and puts the header, with the number of entries, before them, so that a
task that ran twice leaves nothing behind.

Paths are local to all executors or URLs that pyarrow.fs knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans.matrix import SparseMatrix
from .matrix_market import PATTERN_VALUE, Banner

SCHEMA = "seq bigint, i bigint, j bigint, v double"
#: Bytes of a range, and of what a task parses at a time.
SPLIT, CHUNK = 64_000_000, 4_000_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file, or the folder's files that aren't hidden, by name."""
    system, where = _place(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"there is nothing at {path}")
    if info.type == fs.FileType.File:
        return system, [info]
    found = [f for f in system.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return system, sorted(found, key=lambda f: f.base_name)


@dataclass(frozen=True)
class Header:
    banner: Banner
    n_rows: int
    n_cols: int
    stored: int
    body: int  #: where the first file's entries begin


def header(path: str) -> Header:
    """The banner and the size line of a file or of a folder's first file."""
    system, files = _files(path)
    if not files:
        raise ValueError(f"{path} has no files")
    banner, at = None, 0
    with system.open_input_stream(files[0].path) as raw:
        rest = b""
        while True:
            more = raw.read(65536)
            *lines, rest = (rest + more).split(b"\n") if more else (rest, b"")
            for line in lines:
                at += len(line) + 1
                said = line.decode().strip()
                if banner is None:
                    banner = Banner.parse(said)
                elif said and not said.startswith("%"):
                    numbers = [int(x) for x in said.split()]
                    if banner.format != "coordinate" or len(numbers) != 3 or banner.field == "complex" or banner.symmetry not in ("general", "symmetric"):
                        raise ValueError(f"only real, integer or pattern, general or symmetric coordinate files: {banner}, {said!r}")
                    return Header(banner, *numbers, min(at, files[0].size))
            if not more:
                raise ValueError(f"{path} has no banner or no size line")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    before: int  #: bytes of the files before


class MtxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.header = header(self.path)

    def partitions(self) -> list[Range]:
        _, files = _files(self.path)
        out, before = [], 0
        for k, f in enumerate(files):
            first = self.header.body if k == 0 else 0
            out += [Range(f.path, start, min(start + self.split, f.size), before) for start in range(first, f.size, self.split)]
            before += f.size
        return out or [Range(files[0].path, 0, 0, 0)]

    def _entries(self, lines: list[bytes], at: np.ndarray, before: int) -> Iterator[pa.RecordBatch]:
        """Rows of whole lines and their places."""
        some = [k for k, line in enumerate(lines) if (bare := line.strip()) and not bare.startswith(b"%")]
        if not some:
            return
        words = [lines[k].split() for k in some]
        width = 2 if self.header.banner.field == "pattern" else 3
        if any(len(w) < width for w in words):
            raise ValueError(f"{self.path}: a line of an entry has fewer than {width} numbers")
        i, j = (np.array([int(w[k]) for w in words], np.int64) - 1 for k in (0, 1))
        v = np.full(len(words), PATTERN_VALUE) if width == 2 else np.array([float(w[2]) for w in words])
        if i.min() < 0 or j.min() < 0 or i.max() >= self.header.n_rows or j.max() >= self.header.n_cols:
            raise ValueError(f"{self.path}: an entry lies outside {self.header.n_rows} x {self.header.n_cols}")
        seq = 2 * (before + at[some])
        if self.header.banner.symmetry == "symmetric":
            off = i != j
            i, j, v, seq = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([v, v[off]]), np.concatenate([seq, seq[off] + 1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seq, i, j, v)], ["seq", "i", "j", "v"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        system, _ = _place(self.path)
        with system.open_input_file(partition.path) as raw:
            # a line that begins before the range is another's: look at the byte before it
            whole = partition.start == 0 or raw.read_at(1, partition.start - 1) == b"\n"
            at, rest = partition.start, b""
            while True:
                more = raw.read_at(CHUNK, at + len(rest))
                *lines, rest = (rest + more).split(b"\n")
                if not more:
                    lines, rest = [rest], b""
                places = at + np.concatenate([[0], np.cumsum([len(line) + 1 for line in lines])]).astype(np.int64)
                if lines and not whole:
                    lines, places, whole = lines[1:], places[1:], True
                mine = int(np.searchsorted(places[:-1], partition.stop, side="left"))
                yield from self._entries(lines[:mine], places[:mine], partition.before)
                if not more or mine < len(lines) or places[-1] >= partition.stop:
                    return
                at = int(places[-1])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str
    entries: int
    n_rows: int
    n_cols: int


class MtxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.options = options["path"], options
        self.field = options.get("field", "real")
        system, where = _place(self.path)
        if not overwrite and system.get_file_info(where).type != fs.FileType.NotFound:
            raise ValueError(f"there is something at {self.path} already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, where = _place(self.path)
        system.create_dir(where, recursive=True)
        mine, count, most = f"{where}/.{uuid.uuid4().hex}", 0, [0, 0]
        with system.open_output_stream(mine) as out:
            for batch in iterator:
                i, j, v = (batch.column(c).to_pylist() for c in ("i", "j", "v"))
                said = {"real": lambda x: f" {x!r}", "integer": lambda x: f" {int(x)}", "pattern": lambda x: ""}[self.field]
                out.write("".join(f"{a + 1} {b + 1}{said(x)}\n" for a, b, x in zip(i, j, v, strict=True)).encode())
                count += len(i)
                most = [max([most[0], *(a + 1 for a in i)]), max([most[1], *(b + 1 for b in j)])]
        return Written(TaskContext.get().partitionId(), mine, count, *most)

    def commit(self, messages: list[Written]) -> None:
        system, where = _place(self.path)
        system.create_dir(where, recursive=True)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        for f in system.get_file_info(fs.FileSelector(where)):  # what was there, and what tasks that failed have left
            if f.path.removeprefix("/") not in {m.path.removeprefix("/") for m in done}:
                system.delete_file(f.path)
        size = [int(self.options.get(name, max([0, *(getattr(m, f"n_{name}") for m in done)]))) for name in ("rows", "cols")]
        with system.open_output_stream(f"{where}/part-header") as out:
            out.write(f"{Banner(field=self.field)}\n{size[0]} {size[1]} {sum(m.entries for m in done)}\n".encode())
        for k, m in enumerate(done):
            system.move(m.path, f"{where}/part-header-{k:010d}")

    def abort(self, messages: list[Written]) -> None:
        system, _ = _place(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class MtxDataSource(DataSource):
    """Options: path; split, bytes of a range; in writing rows, cols, and field (real, integer or pattern)."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MtxReader:
        return MtxReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MtxWriter:
        return MtxWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MtxDataSource)


def load(spark: SparkSession, path: str, split: int = SPLIT) -> SparseMatrix:
    """The matrix at path; entries that the size line doesn't account for are refused."""
    register(spark)
    said, entries = header(path), spark.read.format("mtx").option("split", split).load(path)
    stored = entries.where("seq % 2 = 0").count()
    if stored != said.stored:
        raise ValueError(f"{path}: {stored} entries, the size line says {said.stored}")
    return SparseMatrix(entries, said.n_rows, said.n_cols)


def save(a: SparseMatrix, path: str, field: str = "real") -> None:
    """Entries by row in the folder's files."""
    register(a.spark)
    rows: DataFrame = a.entries.repartitionByRange("i", *a.order).sortWithinPartitions("i", *a.order).select("i", "j", "v")
    rows.write.format("mtx").options(rows=a.n_rows, cols=a.n_cols, field=field).mode("overwrite").save(path)
