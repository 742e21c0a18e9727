"""Spans in texts: digests of span lists, filters of fixed size, and rewriting texts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, null_safe, slices, unused

#: Slots of a filter for each key, and at most: 16 MB of bits, whatever the input.
SLOTS_A_KEY, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 16, 1 << 27


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


class Cover:
    """Whether a range touches any of a list of spans, in a time that grows with the list's logarithm."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = [s for s, _ in sorted(spans)]
        self.ends = list(accumulate((e for _, e in sorted(spans)), max))

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


class HashFilter:
    """Which slots the 64-bit hashes of some keys fall into; sent to all tasks.

    A hash that isn't among them may pass, so exact steps follow; one that is always
    passes. With more keys than MOST_SLOTS / SLOTS_A_KEY it gets fuller and passes more.
    """

    def __init__(self, words: np.ndarray, slots: int):
        self.bits, self.slots = words.view(np.uint8), slots

    @property
    def fill(self) -> float:
        return float(np.bitwise_count(self.bits).sum()) / self.slots

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = mixed(hashes) & np.uint64(self.slots - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Which strings may be among the keys, where those are hashed by xxhash64."""
        import xxhash

        return self(np.fromiter((xxhash.xxh64_intdigest(t.encode(), 42) for t in texts), np.uint64, len(texts)))


def hash_filter(keys: DataFrame, hashed: Column, each: int = SLOTS_A_KEY, most: int = MOST_SLOTS) -> HashFilter:
    """A filter over a column of 64-bit hashes, such as xxhash64 gives them, with `each` slots a key.

    Tasks set the bits of their rows, and words of equal place are put together by OR:
    one word for 64 slots reaches the driver at most, which `most` bounds.
    """
    rows = keys.count()
    slots = min(most, max(LEAST_SLOTS, 1 << (each * max(1, rows) - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mixed(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(slots - 1))
            place, start = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = keys.select(hashed.alias("h")).where("h is not null").mapInArrow(words, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(slots // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return HashFilter(out, slots)


def hash_filter_for_tasks(keys: DataFrame, hashed: Column, each: int = SLOTS_A_KEY) -> Broadcast[HashFilter]:
    return keys.sparkSession.sparkContext.broadcast(hash_filter(keys, hashed, each))


def rewrite(docs: DataFrame, spans: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """docs with the spans of each text replaced; all columns of docs are kept.

    spans: one row (id_col, sig, cuts) for a text, sig its xxhash64, cuts an array of
    structs (start, end, put) in code points. Of overlapping cuts the first stays and
    covers the rest. Texts without a row of spans stay as they are; null stays null.
    """
    sig, cuts = unused("__sig", docs, spans), unused("__cuts", docs, spans)
    named = docs.withColumn(sig, F.xxhash64(text_col))
    joined = null_safe(named, spans.select(F.col(id_col), F.col("sig").alias(sig), F.col("cuts").alias(cuts)), [id_col, sig], "left")

    @F.pandas_udf("string")
    def cut(texts, cuts):
        def one(text, some):
            out, at = [], 0
            for c in sorted(some, key=lambda x: (x["start"], -x["end"])):
                if c["start"] >= at:
                    out += [text[at : c["start"]], c["put"]]
                at = max(at, c["end"])
            return "".join([*out, text[at:]])

        return texts.combine(cuts, lambda t, c: t if t is None or c is None or not len(c) else one(t, c))

    changed = joined.where(F.col(cuts).isNotNull()).withColumn(text_col, cut(text_col, cuts))
    same = joined.where(F.col(cuts).isNull())
    return changed.select(*docs.columns).unionByName(same.select(*docs.columns))


def text_rows(work, names: list[str], kinds: list[pa.DataType], text: str = "text"):
    """A mapInArrow function: work(row) gives the values of one output row, or None for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = [x for x in map(work, batch.to_pylist()) if x is not None]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run
