"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets a row of precomputed Hamming distances to reference
fingerprints (pivots): to each of them in each of six bands of the bits. A pair's
difference in one distance is at most the pair's own distance in that band, so

* at 3 differing bits or fewer at least three of six bands differ nowhere, and there all
  distances are equal. An equi-join on the distances of three bands, 20 ways to choose
  them, finds every link without comparing all with all;
* a pair whose distances to some pivot over all bits differ by more than 3 is discarded;
* so is one whose largest differences in the bands add up to more than 3;
* only survivors have their bits compared.

Distances over all bits alone can't give join keys: they concentrate around 32, so cells
of neighbouring distances hold a large share of all fingerprints (figures in the README).

Fingerprints that many candidates share are split into blocks that are dealt to tasks
in pairs; a task puts out not all links but a spanning forest of them, from which
components follow by minimum labels with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .common import mixed, null_safe, slices, unsigned, unused, written

#: Bits of each band; a fixed division of the 64.
BANDS = [range(64 * k // 6, 64 * (k + 1) // 6) for k in range(6)]
MASKS = [sum(1 << b for b in band) for band in BANDS]
#: Reference fingerprints.
PIVOTS = mixed(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Fingerprints of one candidate set that one task compares with so many others at most.
BLOCK = 2048


def fingerprint(text: str) -> int:
    """64-bit SimHash of the text's 3-word shingles; no words give 0."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > 3:
        starts, ends = starts[:-2], ends[2:]
    else:
        starts, ends = starts[:1], ends[-1:]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        some = hashes[k : k + 65536]
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(id_type: pa.DataType, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t or "") for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_type), *[batch.column(c) for c in kept], pa.array(unsigned(found))], ["id", *kept, "fp"])

    return run


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hashes: bool = False) -> DataFrame:
    """(id, fp) for each row, fp being the fingerprint as a signed long; with `hashes` also sig and
    row, hashes of the text and of the whole row."""
    kind = docs.schema[id_col].dataType
    more = {"sig": F.xxhash64(docs[text_col]), "row": _row_hash(docs)} if hashes else {}
    some = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[c.alias(n) for n, c in more.items()])
    return some.mapInArrow(_fingerprints(to_arrow_type(kind), list(more)), ", ".join([f"id {kind.simpleString()}", *[f"{n} bigint" for n in more], "fp bigint"]))


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, MapType | VariantType) or (isinstance(kind, ArrayType) and _holds_map(kind.elementType))


def _row_hash(docs: DataFrame) -> Column:
    """Of all columns; those that can't be hashed, for they hold a map somewhere, as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(docs[f"`{f.name}`"])) if _holds_map(f.dataType) else docs[f"`{f.name}`"] for f in docs.schema])


def _forest(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each position the smallest position that the links (left, right) reach."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _links(most: int):
    """Rows (a, b) that connect what the links of each candidate set connect; a set's rows come together."""

    def distances(fps):
        """To each pivot: in each band, and over all bits."""
        bands = np.stack([np.bitwise_count((fps[:, None] ^ PIVOTS) & np.uint64(m)) for m in MASKS], axis=1).astype(np.int8)
        return bands, bands.sum(axis=1, dtype=np.int8)

    def near(fps, table, x, y):
        """The pairs that no table discards and whose bits agree."""
        bands, whole = table
        for k in range(0, len(x), 200_000):
            a, b = x[k : k + 200_000], y[k : k + 200_000]
            ok = (np.abs(whole[a] - whole[b]) <= most).all(axis=1)
            a, b = a[ok], b[ok]
            ok = np.abs(bands[a] - bands[b]).max(axis=2).sum(axis=1) <= most
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(fps[a] ^ fps[b]) <= most
            yield a[ok], b[ok]

    def of_group(fps, side, both):
        """Links in one candidate set; if `both`, only those between the two sides' blocks."""
        table = distances(fps)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 2_000_000 // max(1, len(fps)))
        for k in range(0, len(fps), step):
            close = np.ones((min(step, len(fps) - k), len(fps)), bool)
            for c in range(len(PIVOTS)):
                close &= np.abs(table[1][k : k + step, c, None] - table[1][None, :, c]) <= most
            x, y = np.nonzero(close)
            x += k
            use = (x < y) if not both else (side[x] < side[y])
            for a, b in near(fps, table, x[use], y[use]):
                xs.append(a)
                ys.append(b)
        return np.concatenate(xs), np.concatenate(ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held: pd.DataFrame | None = None

        def linked(frame: pd.DataFrame) -> pa.RecordBatch:
            fps = frame["fp"].to_numpy().view(np.uint64)
            group = frame.groupby(["key", "c1", "c2"], sort=False).ngroup().to_numpy()
            sizes = np.bincount(group)
            xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            # small sets together: row k with row k + d of the same set
            small = sizes[group] <= 64
            blocks = frame["side"].to_numpy()
            both = (frame["c1"] != frame["c2"]).to_numpy()
            table = distances(fps)
            for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
                x = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
                y = x + d
                ok = ~both[x] | (blocks[x] != blocks[y])
                for a, b in near(fps, table, x[ok], y[ok]):
                    xs.append(a)
                    ys.append(b)
            for g in np.flatnonzero(sizes > 64):
                at = np.flatnonzero(group == g)
                x, y = of_group(fps[at], blocks[at], bool(both[at[0]]))
                xs.append(at[x])
                ys.append(at[y])
            x, y = np.concatenate(xs), np.concatenate(ys)
            label = _forest(fps, x, y)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(unsigned(fps[moved])), pa.array(unsigned(fps[label[moved]]))], ["a", "b"])

        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (held[["key", "c1", "c2"]] == held[["key", "c1", "c2"]].iloc[-1]).all(axis=1)
            if len(held) > 50_000 and not last.all():
                yield linked(held[~last].reset_index(drop=True))
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield linked(held)

    return run


def linking_edges(prints: DataFrame, most: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that have the components of all links."""
    if most > 3:
        raise ValueError("six bands are exact for 3 differing bits or fewer")
    distance = lambda pivot, mask: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(pivot)))).bitwiseAND(F.lit(_signed(mask)))).cast("tinyint")
    table = prints.select("fp", *[F.array(*[distance(p, m) for p in PIVOTS]).alias(f"b{k}") for k, m in enumerate(MASKS)])
    # a hash stands for the distances: should two rows of distances share one, that adds a candidate
    rows = [F.xxhash64(F.lit(n), *[f"b{k}" for k in three]) for n, three in enumerate(combinations(range(6), 3))]
    keyed = table.select("fp", F.explode(F.array(*rows)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = met.select("key", "fp", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("key", "fp", "side", F.least("side", "o").alias("c1"), F.greatest("side", "o").alias("c2"))
    dealt = met.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "fp")
    return dealt.mapInArrow(_links(most), "a bigint, b bigint").distinct()


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the smallest node that it reaches.

    Each round takes the smallest label among the neighbours, hooks the old label to it,
    and jumps; labels are written each round, so no lineage grows and a lost executor
    costs one round at most.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        # the smallest label in each node's neighbourhood
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), F.col("root").alias("low"))
        near = labels.select("node", F.col("root").alias("low"), F.col("root").alias("old")).unionByName(seen, allowMissingColumns=True).groupBy("node").agg(F.min("low").alias("low"), F.max("old").alias("old"))
        # written, as it is read four times, for each of which Spark may join all edges again
        near = written(near)
        # the old label learns it too, then every node takes its label's label
        hooks = near.select(F.col("old").alias("node"), "low").unionByName(near, allowMissingColumns=True).groupBy("node").agg(F.min("low").alias("low"), F.max("old").alias("old"))
        jumped = hooks.join(hooks.select(F.col("node").alias("low"), F.col("low").alias("lower")), "low", "left")
        after = written(jumped.select("node", F.coalesce("lower", "low").alias("root"), "old"))
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, most: int, hashes: bool) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of each row, and (fp, first, root) of each fingerprint: its least id and its component."""
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, hashes=hashes))
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(linking_edges(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    return prints, distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """One row (id, fingerprint, component_id) for each row of docs.

    Fingerprints link at `most` differing bits or fewer; component_id is the smallest id
    of a document that links reach, itself included. Null and empty texts have the
    fingerprint 0, which links like any other. Null ids are smaller than none: a
    component with only null ids has a null component_id. Repeated rows each give a
    row. Other columns are ignored; an empty table gives an empty result.
    """
    prints, classes = _classes(docs, id_col, text_col, most, False)
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    known = classes.join(smallest, "root").select("fp", "component_id")
    out = prints.join(known, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """One row of docs, with all its columns, for each component of linked fingerprints.

    It is the one with the smallest id (null ids only where there is no other), then the
    smallest hash of its text, then of the whole row; of rows equal in all that one stays.
    Null and empty texts are one component. An empty table gives an empty result.
    """
    prints, classes = _classes(docs, id_col, text_col, most, True)
    names = [unused(f"__{c}", docs) for c in ("sig", "row")]
    keys = [id_col, *names]
    rows = prints.groupBy("id", "sig", "row", "fp").agg(F.count("*").alias("n")).join(classes.select("fp", "root"), "fp")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "sig", "row", "n")).alias("b"))
    best = written(best.select(F.col("b.id").alias(id_col), F.col("b.sig").alias(names[0]), F.col("b.row").alias(names[1]), F.col("b.n").alias("n")))
    named = docs.withColumns({names[0]: F.xxhash64(docs[text_col]), names[1]: _row_hash(docs)})
    kept = lambda some: null_safe(named, some.select(*keys), keys, "left_semi")
    return kept(best.where("n = 1")).unionByName(kept(best.where("n > 1")).dropDuplicates(keys)).select(*[f"`{c}`" for c in docs.columns])
