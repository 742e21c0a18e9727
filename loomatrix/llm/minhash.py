"""MinHash near-duplicates with fast similarity sketches.

A document is its set of distinct word shingles. A sketch has `bands * rows` bins. In
round i every shingle falls into one bin, at the value i + h, and a bin keeps its smallest
value; rounds end when all bins are filled, which takes a number of hashes near the set's
size for large sets. Rounds after the first `bins` put all shingles into one bin each, so
that every bin is filled for the smallest sets too. Two sets agree in a bin with
probability of their similarity, and the bins behave as if drawn without replacement, so
that the share of equal bins keeps within the usual concentration bounds.

Sets are compared in steps, each of which confirms links on the full sets:

1. sets whose bins agree in a whole band share a bucket. In each bucket the set that shares
   most with others is its hub; each set is confirmed against the hub that it meets most.
   So a group of copies of one original takes one comparison each;
2. buckets that still hold several components have the others compared with all, in blocks
   dealt to tasks in pairs, by sizes and sketches only. What is left connects candidates to
   small clusters;
3. each cluster's full sets meet once, in blocks again, and links between components are
   confirmed. Tasks put out spanning forests, never all pairs.

A link at the least similarity of 0.85 is missed with a probability below 1e-8: by the
bands (1 - 0.85**5)**32 = 7e-9, by a sketch that agrees in fewer than `SHOWN` of its
bins about as much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lower_ascii, mixed, slices, unsigned, window_hashes, words_of, written
from .simhash import _forest, components
from .spans import hash_filter_for_tasks

BANDS, ROWS = 32, 5
#: Sketches of linked sets agree in this share of their bins at least.
SHOWN = 0.65
#: Sets of one bucket or cluster that one task compares with so many others at most, and their shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
BASE = 0xD1342543DE82EF95
EMPTY = np.uint64((1 << 64) - 1)


def shingle_sets(texts: pa.Array, length: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; lower case for A to Z only."""
    import xxhash

    codes, distinct, offsets = words_of(lower_ascii(texts))
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in distinct], np.uint64)
    words = hashes[codes] if len(hashes) else np.zeros(0, np.uint64)
    windows = window_hashes(words, length, BASE)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(np.unique(windows[a : b - length + 1]))
        else:  # a base of its own for each length, so that whole sequences and shingles don't meet
            out.append(window_hashes(words[a:b], b - a, BASE + 2 * (b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """(len(sets), bins) values round * 2**32 + 32 bits of hash; all bins of sets with members are filled."""
    out = np.full((len(sets), bins), EMPTY, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    members = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for k in range(2 * bins):
        if not len(members):
            break
        hashed = mixed(members + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = (hashed & low) | np.uint64(k << 32)
        if k < bins:
            at = ((hashed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        else:
            at = k - bins
        np.minimum.at(flat, owner * bins + at, value)
        filled = (out != EMPTY).all(axis=1)
        left = ~filled[owner]
        members, owner = members[left], owner[left]
    return out


def _scan(bands: int, rows: int, length: int, id_type: pa.DataType):
    """(id, row, node, size, bands, sketch): node names the set; for each band a hash of its bins; a byte of each bin."""
    names = ["id", "row", "node", "size", "bands", "sketch"]
    odd = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), length)
            found = sketches(sets, bands * rows)
            keys = mixed((found.reshape(-1, bands, rows) * odd).sum(axis=2, dtype=np.uint64) + mixed(np.arange(1, bands + 1, dtype=np.uint64)))
            short = mixed(found).astype(np.uint8)
            node = [hashlib.sha256(s.tobytes()).digest()[:16] for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(unsigned(keys.ravel())))
            columns = [batch.column("id").cast(id_type), batch.column("row"), pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists, pa.array([s.tobytes() for s in short], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _wanted_sets(wanted, length: int):
    """(row, node, shingles) of rows that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            few = batch.filter(pa.array(wanted.value(batch.column("row").to_numpy().view(np.uint64))))
            sets = shingle_sets(few.column("text"), length)
            node = [hashlib.sha256(s.tobytes()).digest()[:16] for s in sets]
            yield pa.RecordBatch.from_arrays([few.column("row"), pa.array(node, pa.binary()), pa.array([unsigned(s) for s in sets], pa.list_(pa.int64()))], ["row", "node", "shingles"])

    return run


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, node, label, size, ...) of keys with several labels, dealt to cells (key, c1, c2).

    A key's most frequent label needs no comparison with itself: the others' blocks meet
    all blocks. In a cell of one block all its rows meet, in a cell of two those of different sides.
    """
    per = rows.groupBy(key, "label").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    many = per.groupBy(key).agg(F.max(F.struct("n", "label", "w")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("labels > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(w / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    many = many.select(key, F.col("top.label").alias("most"), blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("few"), blocks(F.col("top.n"), F.col("top.w")).alias("others"))
    met = rows.join(many, key).withColumn("minor", F.col("label") != F.col("most"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("others"))).cast("int")
    met = met.withColumn("side", F.when(F.col("minor"), mine).otherwise(F.col("few") + mine))
    meets = F.sequence(F.lit(0), F.when(F.col("minor"), F.col("few") + F.col("others")).otherwise(F.col("few")) - 1)
    met = met.withColumn("o", F.explode(meets)).withColumns({"c1": F.least("side", "o"), "c2": F.greatest("side", "o")})
    return met.drop("most", "few", "others", "minor", "o").repartition(key, "c1", "c2").sortWithinPartitions(key, "c1", "c2", "node")


def _whole_cells(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells with each row's cell; sorted rows come in any batches."""
    held: pa.Table | None = None

    def starts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for name in (key, "c1", "c2"):
            column = table.column(name)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
        return new

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= least:
            held = held.combine_chunks()
            new = starts(held)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield held.slice(0, last), np.cumsum(new[:last]) - 1
                held = held.slice(last)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, np.cumsum(starts(held)) - 1


def _close_pairs(table: pa.Table, cell: np.ndarray, similarity: int, bins: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, equal bins) of rows of one cell that differ in label, whose sizes allow a link and whose sketches show one."""
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, bins)
    size, side = table.column("size").to_numpy(), table.column("side").to_numpy()
    label = pc.dictionary_encode(table.column("label")).combine_chunks()
    label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
    two = (table.column("c1").to_numpy() != table.column("c2").to_numpy())
    counts = np.bincount(cell)

    def agree(x, y):
        ok = (label[x] != label[y]) & (~two[x] | (side[x] != side[y]))
        ok &= 100 * np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
        x, y = x[ok], y[ok]
        for k in range(0, len(x), 50_000):
            a, b = x[k : k + 50_000], y[k : k + 50_000]
            equal = (sketch[a] == sketch[b]).sum(axis=1)
            near = equal >= SHOWN * bins
            yield a[near], b[near], equal[near]

    small = counts[cell] <= 64
    for d in range(1, int(counts[counts <= 64].max(initial=1))):
        x = np.flatnonzero(small[:-d] & (cell[:-d] == cell[d:]))
        yield from agree(x, x + d)
    ends = np.cumsum(counts)
    for g in np.flatnonzero(counts > 64).tolist():
        first, stop = int(ends[g] - counts[g]), int(ends[g])
        for x in range(first, stop):
            y = np.arange(x + 1, stop)
            yield from agree(np.full(len(y), x), y)


def _edges(table: pa.Table, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Pairs of nodes that connect what the links between these rows connect; a node's rows, in whatever cells, are one."""
    named = table.column("node").combine_chunks().dictionary_encode()
    code, node = named.indices.to_numpy(), named.dictionary
    reached = _forest(np.arange(len(node)), code[x], code[y])
    moved = np.flatnonzero(reached != np.arange(len(reached)))
    return pa.RecordBatch.from_arrays([node.take(pa.array(moved)), node.take(pa.array(reached[moved]))], ["a", "b"])


def _candidate_edges(similarity: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in _whole_cells(batches, "band", 20_000):
            pairs = [p[:2] for p in _close_pairs(table, cell, similarity, bins)]
            x, y = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
            yield _edges(table, x, y)

    return run


def _confirmed_edges(similarity: int, bins: int):
    """Most alike pairs first; pairs that links found so far connect aren't looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in _whole_cells(batches, "cluster", 256):
            pairs = list(_close_pairs(table, cell, similarity, bins))
            x, y, equal = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1, 2))
            above = list(range(table.num_rows))

            def top(k: int) -> int:
                while above[k] != k:
                    above[k] = above[above[k]]
                    k = above[k]
                return k

            sets = table.column("shingles").combine_chunks()
            links = []
            for k in np.argsort(-equal, kind="stable").tolist():
                a, b = top(int(x[k])), top(int(y[k]))
                if a == b:
                    continue
                one, other = sets[int(x[k])].values.to_numpy(), sets[int(y[k])].values.to_numpy()
                both = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * both >= similarity * (len(one) + len(other) - both):
                    above[max(a, b)] = min(a, b)
                    links.append((int(x[k]), int(y[k])))
            found = np.array(links, np.int64).reshape(-1, 2)
            yield _edges(table, found[:, 0], found[:, 1])

    return run


def minhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: int = 85, length: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of docs.

    Words stand between ASCII white space, in lower case for A to Z. A set is the distinct
    shingles of `length` words, or all words as one where there are fewer; null texts and
    texts without words have none and are linked with nothing, their component is their
    own id. Sets link at 100 * intersection >= similarity * union; component_id is the
    smallest id that links reach, kept whether it is the row's own. Null ids are smaller
    than none: a component of null ids only has a null component_id and all its rows are
    kept. Repeated rows, and rows of one id, each give a row; other columns are ignored; an
    empty table gives an empty result.
    """
    kind, bins = docs.schema[id_col].dataType, bands * rows
    arrow, sql = to_arrow_type(kind), kind.simpleString()
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("row"))
    prints = written(base.mapInArrow(_scan(bands, rows, length, arrow), f"id {sql}, row bigint, node binary, size bigint, bands array<bigint>, sketch binary"))
    sets = prints.where("size > 0").groupBy("node").agg(F.min("id").alias("first"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    sets = written(sets)

    # sets that share a bucket with others; a hub stands above all that it is compared with
    placed = sets.select("node", "size", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = written(placed.join(shared, "band"))
    standing = met.groupBy("node").agg(F.sum("n").alias("standing"))
    hubs = met.join(standing, "node").groupBy("band").agg(F.max(F.struct("standing", "node", "size")).alias("hub"))
    spokes = met.join(hubs, "band").where("node <> hub.node").groupBy("node").agg(F.first("size").alias("size"), F.max("hub").alias("hub"))
    spokes = spokes.where(100 * F.least("size", "hub.size") >= similarity * F.greatest("size", "hub.size")).select("node", F.col("hub.node").alias("hub"))

    # the full sets of all that may be linked, one row's text for each
    wanted = written(sets.select("node", "row").join(met.select("node").distinct(), "node", "left_semi"))
    full = base.mapInArrow(_wanted_sets(hash_filter_for_tasks(wanted, F.col("row")), length), "row bigint, node binary, shingles array<bigint>")
    full = written(full.join(wanted, ["row", "node"], "left_semi").dropDuplicates(["row", "node"]).select("node", "shingles"))
    pairs = spokes.join(full, "node").join(full.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
    both = F.size(F.array_intersect("shingles", "hub_shingles"))
    union = F.size("shingles") + F.size("hub_shingles") - both
    links = written(pairs.where(100 * both >= similarity * union).select(F.col("node").alias("a"), F.col("hub").alias("b")))

    # what hubs left apart: by sketches within buckets, then by full sets within clusters; a set is known
    # to be connected with its hub and the hub's hub, so they needn't be compared
    above = links.select(F.col("a").alias("b"), F.col("b").alias("top"))
    labels = links.join(above, "b", "left").select(F.col("a").alias("node"), F.coalesce("top", "b").alias("label"))
    known = sets.select("node", "size", "sketch").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = met.select("band", "node").join(known, "node")
    maybe = written(_cells(apart, "band").mapInArrow(_candidate_edges(similarity, bins), "a binary, b binary").distinct())
    clusters = components(maybe).withColumnRenamed("root", "cluster")
    cells = _cells(clusters.join(known, "node").join(full, "node"), "cluster")
    more = cells.mapInArrow(_confirmed_edges(similarity, bins), "a binary, b binary")
    roots = components(links.union(more)).withColumnRenamed("node", "member")

    rooted = sets.select("node", "first").join(roots, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = written(rooted.join(smallest, "root").select("node", "component_id"))
    out = prints.select("id", "node", "size").join(found, "node", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
