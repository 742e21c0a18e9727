"""Substring dedup of word windows by level-wise doubling.

A window of words can repeat only if all its windows of half the length do. So windows of
a first length are counted over the corpus; those that repeat are extended to twice that
length and counted again, and so on, until no candidates survive or the wanted length is
reached. What still repeats there is removed where the same words started earlier.

A level needn't look at every window: each window of twice its length is represented by
the smallest hash among the windows of the level's length in it (its anchor). Equal
windows have equal anchors in the same place, so this loses none, and neighbours mostly
share an anchor. Which hashes repeat is told to tasks by a filter of bounded size; what
it passes by mistake is settled by the exact steps that follow.

At the wanted length, neighbouring windows with one anchor form a run. Runs of equal words
are settled as a whole: all but the earliest go. Windows of different runs can be equal
only where the runs share an anchor; those windows are compared one by one. So a passage
with thousands of copies costs a row a copy and run, and texts move once, for the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, null_safe, slices, unsigned, window_hashes, words_of, written
from .spans import HashFilter, hash_filter, hash_filter_for_tasks

# fixed values: odd multipliers of the window hashes
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Rows of an Arrow batch that a task puts out.
OUT_ROWS = 100_000
#: A filter that is fuller than this prunes too little: the exact table is joined as well.
FULL = 0.2
#: Levels that are done: their lengths and which anchors repeat there.
Levels = list[tuple[int, HashFilter]]


class _Coded:
    """A slice's words as hashes, with its texts' borders."""

    def __init__(self, batch: pa.RecordBatch):
        import xxhash

        codes, words, self.offsets = words_of(batch.column("text"))
        digests = b"".join([xxhash.xxh3_128_digest(w) for w in words or [""]])
        each = np.frombuffer(digests, "<u8").reshape(-1, 2)
        #: two independent hashes of each word
        self.values, self.values_b = each[codes, 0], each[codes, 1]
        self.owner = np.repeat(np.arange(batch.num_rows), np.diff(self.offsets))
        self.known: dict[int, np.ndarray] = {}

    def hashes(self, length: int, base: int = BASE_A) -> np.ndarray:
        """Padded to the number of words; meaningless where within() is false."""
        if base == BASE_A and length in self.known:
            return self.known[length]
        out = np.zeros(len(self.values), np.uint64)
        got = window_hashes(self.values if base == BASE_A else self.values_b, length, base)
        out[: len(got)] = got
        if base == BASE_A:
            self.known[length] = out
        return out

    def within(self, start: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows at these starts stay in the text to which `start` belongs."""
        return start + length <= self.offsets[1:][self.owner[start]]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, anchor): all windows' starts and the place of each one's anchor."""
        base = window // 2
        low = self.hashes(base)
        at = np.arange(len(low))
        span, reach = 1, window - base + 1
        while span < reach:
            step = min(span, reach - span)
            n = len(low) - step
            if n <= 0:
                break
            right = low[step:] < low[:n]
            low, at = np.where(right, low[step:], low[:n]), np.where(right, at[step:], at[:n])
            span += step
        starts = np.flatnonzero(self.within(np.arange(len(self.values)), window)) if len(self.values) else np.zeros(0, np.int64)
        return starts, at[starts] if len(starts) else starts

    def extended(self, length: int, live: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(starts, anchor) of the windows of twice the length whose windows of that length are all live."""
        starts, at = self.anchors(2 * length)
        if live is not None and len(starts):
            dead = np.concatenate([[0], np.cumsum(~live)])
            ok = dead[starts + length + 1] == dead[starts]
            starts, at = starts[ok], at[ok]
        return starts, at

    def surviving(self, levels: Levels) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(starts, anchor, live) of the windows that may repeat at twice the last level's length."""
        live, starts, at = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for length, filled in levels:
            starts, at = self.extended(length, live)
            hit = filled(self.hashes(length)[at])
            starts, at = starts[hit], at[hit]
            live = np.zeros(len(self.values) + 1, bool)
            live[starts] = True
        return starts, at, live

    def place(self, index: np.ndarray) -> np.ndarray:
        """Word numbers in the whole slice as numbers in each text."""
        return index - self.offsets[self.owner[index]]


def _batches(arrays: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names)
    for k in range(0, whole.num_rows, OUT_ROWS):
        yield whole.slice(k, OUT_ROWS)


def _keys(batch: pa.RecordBatch, keys: list[str], rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(rows)) for k in keys]


def _anchor_counts(length: int, levels: Broadcast[Levels]):
    """Rows (h, n): the slice's anchors of this length in what survived the levels before."""

    def run(batches):
        for batch in slices(batches, "text"):
            coded = _Coded(batch)
            _, at = coded.extended(length, coded.surviving(levels.value)[2])
            at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
            found, n = np.unique(coded.hashes(length)[at], return_counts=True)
            yield from _batches([pa.array(unsigned(found)), pa.array(n)], ["h", "n"])

    return run


def _run_rows(window: int, keys: list[str], levels: Broadcast[Levels]):
    def run(batches):
        for batch in slices(batches, "text"):
            coded = _Coded(batch)
            starts, at, _ = coded.surviving(levels.value)
            new = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)] if len(at) else np.zeros(0, bool)
            first, last, anchor = starts[new], starts[np.r_[new[1:], True]] if len(at) else starts, at[new]
            sides = []
            for base in (BASE_A, BASE_B):
                h = coded.hashes(window, base)
                # the windows at both ends cover all words of the run
                sides.append(pa.array(unsigned(mixed(h[first] * np.uint64(BASE_B) + mixed(h[last] + (last - first).astype(np.uint64))))))
            yield from _batches([*sides, pa.array(unsigned(coded.hashes(window // 2)[anchor])), *_keys(batch, keys, coded.owner[first]), pa.array(coded.place(first).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], ["h", "h2", "a", *keys, "at", "n"])

    return run


def _window_rows(window: int, keys: list[str], levels: Broadcast[Levels], shared: Broadcast[HashFilter], holders: Broadcast[HashFilter]):
    """The windows of the chosen texts whose anchors several runs share."""

    def run(batches):
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(holders.value(batch.column("key").to_numpy())))
            coded = _Coded(batch)
            starts, at, _ = coded.surviving(levels.value)
            starts = starts[shared.value(coded.hashes(window // 2)[at])]
            h, h2 = coded.hashes(window)[starts], coded.hashes(window, BASE_B)[starts]
            yield from _batches([pa.array(unsigned(h)), pa.array(unsigned(h2)), *_keys(batch, keys, coded.owner[starts]), pa.array(coded.place(starts).astype(np.int32))], ["h", "h2", *keys, "at"])

    return run


def _kept(window: int, keys: list[str], names: list[str], kinds: list[pa.DataType], spans: bool, texts: bool, moved: Broadcast[HashFilter] | None = None):
    """What is left of each text; without spans, of the texts whose key isn't among the moved ones."""

    def run(batches):
        for batch in slices(batches, "text"):
            if moved is not None:
                batch = batch.filter(pa.array(~moved.value(batch.column("key").to_numpy())))
            codes, words, offsets = words_of(batch.column("text"))
            gone = np.zeros(len(codes) + 1, np.int64)
            if spans:
                packed = _packed(batch.column("spans"))
                first = (packed[1] >> 16) + offsets[:-1][packed[0]]
                np.add.at(gone, first, 1)
                np.add.at(gone, first + (packed[1] & 0xFFFF) + window - 1, -1)
            left = np.cumsum(gone[:-1]) == 0
            table = np.array([*words, ""], object)
            out = []
            removed = np.concatenate([[0], np.cumsum(~left)])
            for k in range(batch.num_rows):
                a, b = offsets[k], offsets[k + 1]
                text = " ".join(table[codes[a:b][left[a:b]]].tolist())
                out.append((int(b - a), int(removed[b] - removed[a]), hashlib.sha256(text.encode()).hexdigest(), text if texts else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    return run


def _packed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all values in the rows' arrays, null arrays having none."""
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _passing(filled: Broadcast[HashFilter]):
    @F.pandas_udf("boolean")
    def passes(hashes):
        import pandas as pd

        return pd.Series(filled.value(hashes.to_numpy()))

    return passes


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str], str]:
    """(table of keys, key and text; names of the keys; their schema). Where ids repeat, a hash of the text tells them apart."""
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    keys = ["id"]
    if not base.groupBy("id").count().where("count > 1").isEmpty():
        base, keys = base.withColumn("tag", F.xxhash64("text")), ["id", "tag"]
    schema = ", ".join(f"{k} {base.schema[k].dataType.simpleString()}" for k in keys)
    return base.select(*keys, _key(keys).alias("key"), "text"), keys, schema


def _key(keys: list[str], of: str = ""):
    return F.xxhash64(*[F.coalesce(F.col(of + k).cast("string"), F.lit("(null)")) for k in keys])


def _levels(base: DataFrame, first: int, upto: int | None = None) -> Iterator[tuple[Levels, DataFrame]]:
    """Level by level the filters so far and the exact table (h) of the last one's repeated
    anchors, up to a length, until no candidates survive."""
    context, levels, length = base.sparkSession.sparkContext, [], first
    while upto is None or length <= upto:
        counts = base.select("text").mapInArrow(_anchor_counts(length, context.broadcast(list(levels))), "h bigint, n bigint")
        many = written(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
        filled = hash_filter(many, F.col("h"))
        if not filled.fill:
            return
        levels.append((length, filled))
        yield levels, many
        length *= 2


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, first: int | None = None, texts: bool = True) -> DataFrame:
    """One row (id, n_words, n_removed, kept_sha256, kept) for each row of docs.

    Words are maximal runs of characters other than space and 9 to 13. A word goes if a
    window of `window` words covers it that also starts earlier: in a text of a smaller
    id, or in the same text before. kept has the words left, joined by one space (null
    unless texts). Levels begin at `first` words (half the window by default), which
    doubled once or more must give the window. Null ids come before all others. Texts of
    one id with different words come in the order of their hashes; repeated rows are one
    document and get the same result. A null text has no words. Other columns are
    ignored; an empty table gives an empty result.
    """
    first = first or window // 2
    doublings = (window // first).bit_length() - 1
    if not 2 <= window <= 60_000 or doublings < 1 or first << doublings != window:
        raise ValueError("window must be from 2 to 60000, and first doubled once or more")
    spark = docs.sparkSession
    base, keys, key_schema = _texts(docs, id_col, text_col)
    names = [*keys, "n_words", "n_removed", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = f"{key_schema}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    result = lambda out: out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")

    found = None
    for found in _levels(base, first, window // 2):
        pass
    if found is None or len(found[0]) < doublings:  # no window of the wanted length can repeat
        return result(base.mapInArrow(_kept(window, keys, names, kinds, False, texts), schema))
    levels, many = found
    done = spark.sparkContext.broadcast(levels)

    # the whole length: runs of equal words, of which all but the earliest go
    order = F.struct(*keys, "at")
    runs = base.mapInArrow(_run_rows(window, keys, done), f"h bigint, h2 bigint, a bigint, {key_schema}, at int, n int")
    if levels[-1][1].fill > FULL:
        runs = runs.join(many.select(F.col("h").alias("a")).hint("merge"), "a").select(*runs.columns)
    runs = written(runs)
    classes = written(runs.groupBy("h", "h2", "a").agg(F.min(order).alias("first"), F.count("*").alias("copies")))
    # written tables are joined, so that Spark can split the rows of a run with very many copies
    copied = classes.where("copies > 1").select("h", "h2", "first").hint("merge")
    late_runs = runs.join(copied, ["h", "h2"]).where(F.col("first") < order).select(*keys, (F.col("at").cast("long") * (1 << 16) + F.col("n")).alias("at"))

    # then the windows of runs that share an anchor with other runs, in the texts that hold an earliest one
    shared = hash_filter_for_tasks(classes.groupBy("a").count().where("count > 1"), F.col("a"))
    holders = hash_filter_for_tasks(classes.where(_passing(shared)("a")).select(_key(keys, "first.").alias("key")).distinct(), F.col("key"))
    windows = written(base.mapInArrow(_window_rows(window, keys, done, shared, holders), f"h bigint, h2 bigint, {key_schema}, at int"))
    sooner = written(windows.groupBy("h", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("first") < F.col("last")).drop("last"))
    late = windows.join(sooner.hint("merge"), ["h", "h2"]).where(F.col("first") < order).select(*keys, (F.col("at").cast("long") * (1 << 16) + 1).alias("at"))
    spans = written(late_runs.union(late).groupBy(*keys).agg(F.collect_set("at").alias("spans")))

    # texts without spans stay where they are; the others move to theirs
    marked = hash_filter_for_tasks(spans.select(_key(keys).alias("key")), F.col("key"))
    moved = base.where(_passing(marked)("key")).drop("key")
    with_spans = null_safe(moved, spans.hint("shuffle_hash"), keys, "left")
    return result(with_spans.mapInArrow(_kept(window, keys, names, kinds, True, texts), schema).unionByName(base.mapInArrow(_kept(window, keys, names, kinds, False, texts, marked), schema)))


def _held_anchors(length: int, keys: list[str], levels: Broadcast[Levels]):
    """Rows (h, keys): the anchors of this length in each text, in what survived the levels before."""

    def run(batches):
        for batch in slices(batches, "text"):
            coded = _Coded(batch)
            _, at = coded.extended(length, coded.surviving(levels.value)[2])
            at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
            yield from _batches([pa.array(unsigned(coded.hashes(length)[at])), *_keys(batch, keys, coded.owner[at])], ["h", *keys])

    return run


def repeat_levels(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", first: int = 10) -> DataFrame:
    """(id, length) of each text that holds a repeated anchor: the last level at which it does.

    Levels are first, 2 first, 4 first, ... words, until no candidates survive anywhere;
    an anchor is the window of that length with the smallest hash in a surviving window
    of twice the length. So a text that shares 2 k words with another place reaches
    level k, and none reaches a level whose words stand in one place only. Rows of one id
    and text are one; null ids, null texts and an empty table are as in remove_repeats.
    """
    base, keys, key_schema = _texts(docs, id_col, text_col)
    if len(keys) > 1:
        base = written(base.dropDuplicates(keys))
    context, before, parts = docs.sparkSession.sparkContext, [], []
    for levels, many in _levels(base, first):
        length = levels[-1][0]
        held = base.mapInArrow(_held_anchors(length, keys, context.broadcast(before)), f"h bigint, {key_schema}")
        parts.append(written(held.join(many.hint("merge"), "h").select(*keys).distinct().withColumn("length", F.lit(length))))
        before = list(levels)
    if not parts:
        return base.limit(0).select(F.col("id").alias(id_col), F.lit(0).alias("length"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys).agg(F.max("length").alias("length")).select(F.col("id").alias(id_col), "length")
