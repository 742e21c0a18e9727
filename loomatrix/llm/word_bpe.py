"""BPE encoding and decoding over a table of distinct words.

Texts are split where pieces() proves that a byte-level pre-tokenizer splits too. Each
block of texts (about 16 MB that stand together in the input) lists its distinct words
and keeps, for each text, the words' numbers by position. Spark deals the lists by the
words' hashes; each bucket has a table in which every distinct word of the corpus is
encoded once, and hands the ids back to the blocks that asked for them. A second
exchange, by block, joins ids to positions; for decoding, the ids of each of the block's
words are joined to the vocabulary's pieces. Texts are never shuffled, and what is
travels packed.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pieces, separable, slices
from .token_counts import tokenizer_of

#: Bytes of text in a block.
BLOCK_BYTES = 16_000_000
#: Texts whose positions travel in one row.
TEXTS_A_ROW = 512


def plain_pieces(tokenizer) -> bool:
    """Whether texts may be cut by pieces() and an id's bytes are its piece's, whatever stands beside it."""
    decoder = json.loads(tokenizer.to_str()).get("decoder") or {}
    return separable(tokenizer) and decoder.get("type") == "ByteLevel"


def _pack(*arrays: np.ndarray, data: bytes = b"") -> tuple[int, bytes]:
    """(size, compressed) of arrays of 32-bit numbers and bytes."""
    raw = b"".join([struct.pack("<I", len(arrays)), *[struct.pack("<I", len(a)) for a in arrays], *[a.astype("<u4").tobytes() for a in arrays], data])
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(size: int, blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    (n,) = struct.unpack_from("<I", raw)
    at, arrays = 4 + 4 * n, []
    for length in struct.unpack_from(f"<{n}I", raw, 4):
        arrays.append(np.frombuffer(raw, "<u4", length, at))
        at += 4 * length
    return arrays, raw[at:]


def _cut(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _coded(texts: pa.Array, whole: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(codes, words, offsets); words by falling frequency, so that codes are small."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not whole:
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words] or [False])
        odd = odd[codes] if len(codes) else np.zeros(0, bool)
    if whole or odd.any():
        # some text has white space beside white space: take its pieces one by one
        if whole:
            rows = [[t] for t in texts.to_pylist()]
        else:
            bad = np.add.reduceat(odd, offsets[:-1]) > 0
            rows = [pieces(t.as_py()) if b else None for t, b in zip(texts, bad, strict=True)]
            rows = [r if r is not None else [words[c] for c in codes[offsets[k] : offsets[k + 1]]] for k, r in enumerate(rows)]
        known: dict[str, int] = {}
        codes = np.array([known.setdefault(w, len(known)) for r in rows for w in r], np.int64)
        words = list(known)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    # a text's first piece has no space before it, all others have one
    codes = codes + len(words)
    codes[offsets[:-1]] -= len(words)
    counts = np.bincount(codes, minlength=2 * len(words))
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.int64)
    rank[order] = np.arange(len(order))
    n = len(words)
    return rank[codes], [words[k] if k < n else " " + words[k - n] for k in order.tolist()], offsets


def _blocks(batches: Iterator[pa.RecordBatch], whole: bool):
    """Numbered slices of a task's texts; the same in each pass over the same partitions."""
    for n, batch in enumerate(slices(batches, "text", BLOCK_BYTES)):
        yield (TaskContext.get().partitionId() << 32) + n, batch, *_coded(batch.column("text"), whole)


def _word_rows(path: str, buckets: int):
    import xxhash

    def run(batches):
        whole = not plain_pieces(tokenizer_of(path))
        for block, _, _, words, _ in _blocks(batches, whole):
            data = [w.encode() for w in words]
            bucket = np.array([xxhash.xxh64_intdigest(w) % buckets for w in data], np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            out = [[], [], [], []]
            for some in np.split(order, cuts[1:]):
                mine = [data[k] for k in some.tolist()]
                size, blob = _pack(np.diff(some, prepend=0), np.array([len(w) for w in mine]), data=b"".join(mine))
                for column, value in zip(out, (block, int(bucket[some[0]]), size, blob), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["block", "bucket", "size", "words"])

    return run


def _place_rows(path: str, id_type: pa.DataType):
    import xxhash

    def run(batches):
        whole = not plain_pieces(tokenizer_of(path))
        for block, batch, codes, _, offsets in _blocks(batches, whole):
            ids = batch.column("id").cast(id_type)
            texts = batch.column("text")
            for k in range(0, batch.num_rows, TEXTS_A_ROW):
                stop = min(batch.num_rows, k + TEXTS_A_ROW)
                some = codes[offsets[k] : offsets[stop]]
                # bytes of equal weight stand together, which packs better
                planes = some.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                size, blob = _pack(np.diff(offsets[k : stop + 1]), data=planes)
                check = [xxhash.xxh64_intdigest((t.as_py() or "").encode()) >> 1 for t in texts[k:stop]]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids[k:stop].to_pylist()], pa.list_(id_type)), pa.array([check], pa.list_(pa.int64())), pa.array([size], pa.int32()), pa.array([blob], pa.binary())], ["block", "ids", "checks", "size", "places"])

    return run


@functools.cache
def piece_table(path: str) -> list[bytes]:
    """The bytes of each id; the vocabulary bounds its size."""
    tokenizer = tokenizer_of(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
    added = {t["id"] for t in json.loads(tokenizer.to_str()).get("added_tokens") or []}
    table = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [t.encode() if k in added or any(c not in byte_of for c in t) else bytes(byte_of[c] for c in t) for k, t in enumerate(table)]


def _encode_words(path: str):
    """For each list of words their ids, and where these don't give the words back the words' hashes; rows
    come bucket by bucket."""
    import xxhash

    def run(batches):
        tokenizer = tokenizer_of(path)
        plain = plain_pieces(tokenizer)
        bucket, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                (steps, lengths), data = _unpack(row["size"], row["words"])
                words = _cut(data, lengths)
                new = [w for w in words if w not in known]
                for k in range(0, len(new), 4096):
                    some = new[k : k + 4096]
                    for word, got in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                        known[word] = got.ids
                found = [known[w] for w in words]
                hashes = np.array([] if plain else [xxhash.xxh64_intdigest(w) >> 1 for w in words], np.uint64)
                size, blob = _pack(steps, np.array([len(x) for x in found]), np.array([i for x in found for i in x]), hashes.view("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([size], pa.int32()), pa.array([blob], pa.binary())], ["block", "size", "coded"])

    return run


def _assemble(path: str, names: list[str], kinds: list[pa.DataType], with_ids: bool):
    import xxhash

    def run(places: pa.Table, coded: pa.Table) -> pa.Table:
        tokenizer = tokenizer_of(path)
        plain = plain_pieces(tokenizer)
        table = piece_table(path) if plain else None
        numbers, said, sizes, decoded, lists, hashes = [], [], [], [], [], []
        for size, blob in zip(coded.column("size").to_pylist(), coded.column("coded").to_pylist(), strict=True):
            (steps, counts, ids, hashed), _ = _unpack(size, blob)
            numbers.append(np.cumsum(steps.astype(np.int64)))
            sizes.append(counts)
            shown = [str(i) for i in ids.tolist()]
            ends = np.cumsum(counts.astype(np.int64)).tolist()
            starts = [0, *ends[:-1]] if ends else []
            if plain:
                joined = [table[i] for i in ids.tolist()]
                decoded += [b"".join(joined[a:b]) for a, b in zip(starts, ends, strict=True)]
            else:  # each text is one word
                decoded += [tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(starts, ends, strict=True)]
                hashes.append(hashed.copy().view(np.uint64))
            said += [",".join(shown[a:b]) for a, b in zip(starts, ends, strict=True)]
            if with_ids:
                lists += [ids[a:b] for a, b in zip(starts, ends, strict=True)]
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        n = len(at)
        count = np.zeros(n, np.int64)
        count[at] = np.concatenate(sizes) if sizes else 0
        said_at, decoded_at, list_at = np.empty(n, object), np.empty(n, object), np.empty(n, object)
        said_at[at], decoded_at[at] = said, decoded
        for k, x in zip(at.tolist(), lists, strict=False):
            list_at[k] = x
        hash_at = np.zeros(n, np.uint64)
        if not plain:
            hash_at[at] = np.concatenate(hashes) if hashes else 0
        out = [[] for _ in names]
        for ids, checks, size, blob in zip(*[places.column(c).to_pylist() for c in ("ids", "checks", "size", "places")], strict=True):
            (lengths,), data = _unpack(size, blob)
            codes = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
            start = 0
            for doc, check, length in zip(ids, checks, lengths.tolist(), strict=True):
                mine = codes[start : start + length]
                start += length
                text = b"".join(decoded_at[mine].tolist())
                if (xxhash.xxh64_intdigest(text) >> 1 if plain else int(hash_at[mine[0]])) != check:
                    raise ValueError("positions and words don't belong together: the input changed between its readings")
                row = [doc, int(count[mine].sum()), hashlib.sha256(",".join(said_at[mine].tolist()).encode()).hexdigest(), hashlib.sha256(text).hexdigest()]
                if with_ids:
                    row += [np.concatenate(list_at[mine].tolist()).astype(np.int32) if length else [], text.decode()]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return run


def encode_and_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row (id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, with_ids also
    (ids, decoded).

    ids are those of the tokenizer file, without added special tokens; special strings in
    a text are its default. ids_sha256 is of the decimal ids joined by commas,
    decoded_sha256 of the text that the ids decode to. A null text is empty and has no
    ids. Repeated rows, and rows of one id, each give a row; null ids stay null; other
    columns are ignored; an empty table gives an empty result. Texts are read three times,
    for their size, words and positions; a task fails rather than join words and positions
    of different readings. Tokenizers that aren't plain byte-level BPE get each distinct
    text as one word and decode it whole, as the library does.
    """
    kind = docs.schema[id_col].dataType
    arrow, sql = to_arrow_type(kind), kind.simpleString()
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    # partitions and buckets in proportion to the texts, so that a task's words and blocks don't grow with them
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(usual, 2 * -(-size // BLOCK_BYTES))
    dealt = lambda df, by: df if parts == usual else df.repartition(parts, by)
    buckets = 2 * parts
    words = base.mapInArrow(_word_rows(tokenizer_path, buckets), "block bigint, bucket int, size int, words binary")
    coded = (words.repartition("bucket") if parts == usual else words.repartition(parts, "bucket")).sortWithinPartitions("bucket").mapInArrow(_encode_words(tokenizer_path), "block bigint, size int, coded binary")
    places = base.mapInArrow(_place_rows(tokenizer_path, arrow), f"block bigint, ids array<{sql}>, checks array<bigint>, size int, places binary")
    names, kinds, schema = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"], [arrow, pa.int64(), pa.string(), pa.string()], f"`{id_col}` {sql}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        names, kinds, schema = [*names, "ids", "decoded"], [*kinds, pa.list_(pa.int32()), pa.string()], f"{schema}, ids array<int>, decoded string"
    return dealt(places, "block").groupBy("block").cogroup(dealt(coded, "block").groupBy("block")).applyInArrow(_assemble(tokenizer_path, names, kinds, with_ids), schema)


def decode(rows: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of any table of ids, by a join of each id with its piece.

    The piece table has a row for each id of the vocabulary, which bounds it: it is
    broadcast. Unknown ids decode to nothing; bytes that aren't UTF-8 become U+FFFD;
    a null array gives null, an empty one ''; rows of one id and ids are decoded once each.
    """
    table = piece_table(tokenizer_path)
    pieces_df = rows.sparkSession.createDataFrame([(k, bytes(p)) for k, p in enumerate(table)], "piece_id int, piece binary")
    keyed = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).withColumn("row", F.xxhash64("id", "ids"))
    each = keyed.distinct().select("row", F.posexplode("ids").alias("at", "piece_id")).join(F.broadcast(pieces_df), "piece_id")
    texts = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("some"))
    joined = F.expr("decode(unhex(array_join(transform(some, x -> hex(x.piece)), '')), 'UTF-8')")
    out = keyed.join(texts.select("row", joined.alias("decoded")), "row", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("ids").isNotNull(), F.coalesce("decoded", F.lit(""))).alias("decoded"))
