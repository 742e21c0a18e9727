"""Helpers that several operators share: written tables, text batches and word codes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import new_path, written

__all__ = ["new_path", "written"]

#: Texts are worked on in slices of about so many characters, which bounds a task's memory.
SLICE_CHARS = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice has about `chars` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct, offsets): words between ASCII white space (space, 9 to 13), coded by a
    dictionary of the slice; text k has codes[offsets[k]:offsets[k + 1]]. Null: no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = parts.flatten()
    bounds = parts.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, kept[bounds]


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """coded_words with the distinct words as a list."""
    codes, words, offsets = coded_words(texts)
    return codes, words.to_numpy(zero_copy_only=False).tolist(), offsets


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, bounds) of large strings without nulls: text k is data[bounds[k]:bounds[k + 1]], from byte 0 on."""
    _, places, held = texts.buffers()
    bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def lower_ascii(texts: pa.Array) -> pa.Array:
    """Large strings with A to Z in lower case, null as ''. (Arrow's own ascii_lower reads wrong
    places in arrays whose first offset isn't 0, such as slices of a batch.)"""
    data, bounds = raw_bytes(pc.fill_null(texts.cast(pa.large_string()), ""))
    capital = (data >= ord("A")) & (data <= ord("Z"))
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(np.where(capital, data | 32, data))])


def unsigned(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as the signed longs that Spark has."""
    return values.astype(np.uint64).view(np.int64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def edge_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit number for each word, from its length, its first and its last eight bytes. Equal words
    have equal numbers; different ones may have too."""
    data, bounds = raw_bytes(pc.fill_null(words.cast(pa.large_string()), ""))
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = np.diff(bounds).astype(np.uint64)
    outside = np.uint64(8) * (np.uint64(8) - np.minimum(np.maximum(size, np.uint64(1)), np.uint64(8)))
    head, tail = eight[bounds[:-1] + 8] << outside, eight[bounds[1:]] >> outside
    return mixed(head) ^ mixed(tail + size * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """For each window of `length` values an order-sensitive 64-bit hash.

    Sums of values times powers of base, put together from windows of 1, 2, 4, ... values.
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done = np.zeros(len(values) + 1, np.uint64), 0
    part, power, size = values, base % (1 << 64), 1
    while True:
        if length & size:
            count = len(values) - done - size + 1
            total = total[:count] * np.uint64(power) + part[done : done + count]
            done += size
        if done == length:
            return mixed(total[:n])
        part = part[: len(part) - size] * np.uint64(power) + part[size:]
        power, size = power * power % (1 << 64), size * 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The table in as many partitions as there are cores, if it stands in fewer.

    Tasks can't share a row group, so a table of few row groups would leave most cores
    idle: its rows are dealt out evenly and written once. Tables read in many times as many
    partitions as there are cores, or in as many that have rows (told by the files'
    footers), stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return written(df.repartition(cores))


def vocabulary_path(name: str) -> str:
    """A tokenizer file's place: LOOMATRIX_TOKENIZERS, or the installed public files."""
    folder = os.environ.get("LOOMATRIX_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Cuts a text before each single space between two characters that aren't white space.

    A byte-level BPE pre-tokenizer always begins a new word there: a pre-token holds a
    space only as its first character or in a run of white space, and it looks at
    nothing behind it. So the pieces can be encoded apart. Every piece but the first
    has lost its leading space.
    """
    return _CUT.split(text)


def split_texts(texts: list[str], *known: dict) -> tuple[list[list[str]], set[str], set[str]]:
    """Pieces of each text, and the distinct first and later pieces that `known` lacks.

    str.split does for texts in which no piece begins or ends with white space; others
    go through pieces().
    """
    rows = [text.split(" ") for text in texts]
    new: set[str] = set()
    for row in rows:
        new.update(row)
    bad = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
    if bad:
        rows = [row if bad.isdisjoint(row) else pieces(text) for row, text in zip(rows, texts, strict=True)]
        new = set()
        for row in rows:
            new.update(row[1:])
    first = {row[0] for row in rows}
    if known:
        return rows, first - known[0].keys(), new - known[1].keys()
    return rows, first, new


def separable(tokenizer) -> bool:
    """Whether pieces() is proven for this tokenizer: byte-level BPE with the plain pattern and
    no added token that holds or eats white space."""
    import json

    said = json.loads(tokenizer.to_str())
    before = said.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = said.get("added_tokens") or []
    return bool(
        plain
        and not said.get("normalizer")
        and not said["model"].get("dropout")
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    )


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the tables has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet; the right side's keys go."""
    own = {c: unused(f"__r_{c}", left, right) for c in keys}
    renamed = right.select([F.col(f"`{c}`").alias(own.get(c, c)) for c in right.columns])
    on = [left[f"`{c}`"].eqNullSafe(renamed[f"`{own[c]}`"]) for c in keys]
    return left.join(renamed, on, how).drop(*own.values())
