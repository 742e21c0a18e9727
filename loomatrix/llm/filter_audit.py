"""Audit of how document filters interact, over all orders in which they can be applied.

Texts are scanned where they stand in Arrow's buffers: a table of byte classes and prefix
sums give words, capitals, symbols and code points of all texts of a slice; words get
hashes from one more prefix sum, which are sorted text by text and verified byte for byte,
so that distinct words are counted exactly. What is left of a document is a mask of the
filters that it fails. All orders and steps follow from how many documents of a part have
which mask: documents that pass a set of filters are those whose mask meets none of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import mixed, raw_bytes, slices

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
#: Byte classes; code points start at bytes that don't continue one.
SPACE, CAPITAL, SYMBOL, INSIDE = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[[32, *range(9, 14)]] |= SPACE
CLASSES[ord("A") : ord("Z") + 1] |= CAPITAL
CLASSES[list(b"#$%&*|")] |= SYMBOL
CLASSES[0x80:0xC0] |= INSIDE
#: Bytes that prefix sums are taken of at a time, which bounds their memory.
STEP = 1 << 20
ODD = 0x9E3779B97F4A7C15
LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS, INVERSES = _powers(ODD, STEP), _powers(pow(ODD, -1, 1 << 64), STEP)


def prefix_sums(values: Callable[[int, int], np.ndarray], n: int, at: np.ndarray, kind=np.int64) -> np.ndarray:
    """The sum of the first p of n values for each p of `at`, which rises; values(start, stop) gives some."""
    out, done, carry = np.empty(len(at), kind), 0, np.zeros(1, kind)
    for start in range(0, n, STEP):
        stop = min(n, start + STEP)
        some = np.empty(stop - start + 1, kind)
        some[0] = 0
        np.cumsum(values(start, stop), dtype=kind, out=some[1:])
        some += carry
        upto = int(np.searchsorted(at, stop, side="left"))
        out[done:upto] = some[at[done:upto] - start]
        done, carry = upto, some[-1:]
    out[done:] = carry
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether as many bytes from a on are those from b on."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    equal = np.ones(len(a), bool)
    for k in range(0, 64, 8):
        left = np.flatnonzero(equal & (lengths > k))
        if not len(left):
            return equal
        bits = (np.minimum(lengths[left] - k, 8) * 8).astype(np.uint64)
        differ = (eight[a[left] + k] ^ eight[b[left] + k]) << (np.uint64(64) - bits)
        equal[left] = differ == 0
    for k in np.flatnonzero(equal & (lengths > 64)).tolist():
        equal[k] = np.array_equal(data[a[k] : a[k] + lengths[k]], data[b[k] : b[k] + lengths[k]])
    return equal


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text its words, distinct words, capitals, symbols and code points."""
    data, bounds = raw_bytes(texts)
    said, n = CLASSES[data], len(data)
    count = lambda bit: np.diff(prefix_sums(lambda a, b: said[a:b] & bit != 0, n, bounds))
    out = {"capitals": count(CAPITAL), "symbols": count(SYMBOL), "chars": np.diff(bounds) - count(INSIDE)}

    solid = said & SPACE == 0
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    out["words"] = np.diff(np.searchsorted(starts, bounds))
    owner = np.repeat(np.arange(len(texts)), out["words"])

    blocks = _powers(pow(ODD, STEP, 1 << 64), n // STEP + 1)
    back = _powers(pow(ODD, -STEP, 1 << 64), n // STEP + 1)
    sums = prefix_sums(lambda a, b: LETTERS[data[a:b]] * (POWERS[: b - a] * blocks[a // STEP]), n, np.stack([starts, ends], axis=1).ravel(), np.uint64)
    hashes = (sums[1::2] - sums[::2]) * (INVERSES[starts % STEP] * back[starts // STEP])
    hashes = mixed(hashes + mixed(owner.astype(np.uint64) * np.uint64(ODD)))
    order = np.argsort(hashes)
    met = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    a, b = order[met], order[met + 1]
    fine = (owner[a] == owner[b]) & (ends[a] - starts[a] == ends[b] - starts[b])
    fine[fine] = _same(data, starts[a[fine]], starts[b[fine]], (ends - starts)[a[fine]])
    out["distinct"] = out["words"] - np.bincount(owner[b[fine]], minlength=len(texts))
    for k in np.unique(np.concatenate([owner[a[~fine]], owner[b[~fine]]])).tolist():  # hashes that stand for two words
        mine = np.flatnonzero(owner == k)
        out["distinct"][k] = len({data[s:e].tobytes() for s, e in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)})
    return out


def failures(m: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of the filters A to D that each text fails."""
    a = m["words"] < 50
    b = 100 * m["distinct"] < 65 * m["words"]
    c = 100 * m["capitals"] > 5 * m["chars"]
    return a * BIT["A"] + b * BIT["B"] + c * BIT["C"] + (m["symbols"] > 0) * BIT["D"]


def _masks(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            mask = failures(measure(texts))
            data, bounds = raw_bytes(texts)
            whole = memoryview(data)
            same = [hashlib.sha256(whole[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_type), batch.column("part"), pa.array(mask.astype(np.int32)), pa.array(same, pa.binary())], ["id", "part", "mask", "same"])

    return run


def document_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, same) for each row: the filters A to D that it fails, and its text's SHA-256."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), docs[text_col].alias("text"))
    return rows.mapInArrow(_masks(to_arrow_type(kind)), f"id {kind.simpleString()}, part string, mask int, same binary")


def mask_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents of a part by the filters A to E that they fail.

    Copies are counted before they meet: a text's rows are added up by what else they
    share, with the least id among them, and only such sums are compared within the text.
    """
    said = labels.groupBy(labels[id_col].alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = document_masks(docs, id_col=id_col, text_col=text_col, part_col=part_col).join(said, "id", "left")
    rows = rows.select("id", "part", "mask", "same", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    traits = ["same", "part", "mask", "good", "toxic"]
    sums = rows.groupBy("id", *traits).agg(F.count("*").alias("n"))
    sums = sums.groupBy(*traits, F.isnull("id").alias("no_id")).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    least = F.min("first.id").over(Window.partitionBy("same"))
    copies = F.when(F.col("no_id"), 0).otherwise(F.col("n") - F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    split = sums.withColumn("copies", copies)
    both = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), F.col("copies").alias("n")))
    each = split.select("part", "good", "toxic", F.explode(both).alias("m")).select("part", "good", "toxic", "m.mask", "m.n")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley). A document fails A with fewer than 50 words, B if under 65 % of its words are
    distinct, C if over 5 % of its code points are capitals A to Z, D if it holds one of
    # $ % & * |, E if a row of a smaller id has its text. Each filter removes what it fails
    of what the earlier ones kept; shapley adds up what a step's filter removes over all
    orders. A null text is empty, a null part the part ''; a null id is smaller than none
    and has none smaller; repeated rows count each time and aren't copies of each other; of
    several labels of one id any counts; other columns are ignored; without documents
    there are no rows.
    """
    masks = mask_counts(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)
    all_filters = (1 << len(FILTERS)) - 1
    sets = masks.select("*", F.explode(F.sequence(F.lit(0), F.lit(all_filters))).alias("s")).where("mask & s = 0")
    passing = sets.groupBy("part", "s").agg(*[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])
    parts = passing.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("n", "n_good", "n_toxic")))).alias("passing"))  # 32 sets at most
    orders = parts.withColumn("filter_order", F.lit(""))
    for _ in FILTERS:
        letters = F.array(*map(F.lit, FILTERS))
        orders = orders.withColumn("next", F.explode(F.filter(letters, lambda x: ~F.contains("filter_order", x))))
        orders = orders.withColumn("filter_order", F.concat("filter_order", "next")).drop("next")
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda wanted: sum((F.when(wanted(F.instr("filter_order", f)), b).otherwise(0) for f, b in BIT.items()), F.lit(0))
    steps = steps.withColumn("before", bits(lambda at: at < F.col("step"))).withColumn("own", bits(lambda at: at == F.col("step")))
    of = lambda s, what="n": F.coalesce(F.try_element_at("passing", s)[what], F.lit(0))
    after = F.col("before") + F.col("own")
    lost = lambda what: of(F.col("before"), what) - of(after, what)
    counted = steps.select(
        "part", "filter_order", "step", "own", of(after).alias("kept"), lost("n").alias("removed"), (of(F.lit(0)) - of(F.col("own")) - lost("n")).alias("redundant"),
        (of(F.lit(all_filters) - F.col("own")) - of(F.lit(all_filters))).alias("unique_fails"), lost("n_good").alias("good_lost"), lost("n_toxic").alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
