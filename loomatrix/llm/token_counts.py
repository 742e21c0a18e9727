"""Token counts of texts of any length, by overlap resynchronisation.

Texts up to `chunk_chars` are counted where they are read. Longer ones are cut into
overlapping chunks that Spark deals to all tasks. Each chunk is encoded with offsets,
and neighbours are spliced at a common boundary that is proven stable:

* a pre-token boundary that the left chunk sees at least `GUARD` characters and two
  pre-tokens before its end is one of the whole text, since the pattern looks no
  farther ahead and, by induction, the left chunk was right before it;
* a boundary that the right chunk has at the same place makes all that follows in it
  right, since the pattern looks at nothing behind.

Boundaries are those of the pre-tokenizer: the tokenizer file's post-processor, which may
move offsets behind a leading space, isn't used. The proof holds for byte-level BPE with
the plain pattern; texts of other tokenizers (a space put before the text, a normaliser,
added tokens that are longer than GUARD or take white space with them) are encoded whole.

Where an overlap has no common boundary (a huge word without a break), the texts
concerned are cut anew with twice the overlap, until the splice succeeds or one
chunk holds the whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe, separable, slices, split_texts, written

#: Characters before a chunk's end in which a boundary isn't trusted; longer than any special token.
GUARD = 64
#: Pieces whose counts a task remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 1_000_000

_tokenizers: dict[str, object] = {}


def tokenizer_of(path: str):
    """The tokenizer file, read once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _tokenizers[path] = made
    return _tokenizers[path]


def splicing_tokenizer(path: str):
    """The tokenizer without its post-processor, for boundaries in chunks; None where splicing isn't proven.

    The post-processor adds special tokens, which aren't wanted, and trims offsets; it
    changes no other ids.
    """
    key = f"{path}\nsplicing"
    if key not in _tokenizers:
        tokenizer = tokenizer_of(path)
        said = json.loads(tokenizer.to_str())
        short = all(len(t["content"]) < GUARD for t in said.get("added_tokens") or [])
        made = None
        if short and separable(tokenizer):
            from tokenizers import Tokenizer

            made = Tokenizer.from_str(json.dumps(said | {"post_processor": None}))
        _tokenizers[key] = made
    return _tokenizers[key]


class _Counter:
    """Token counts of whole texts; every distinct piece is encoded once."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        self.safe = separable(self.tokenizer)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def _learn(self, known: dict[str, int], new: list[str], lead: str) -> None:
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            got = self.tokenizer.encode_batch_fast([lead + w for w in part], add_special_tokens=False)
            known.update(zip(part, map(len, got), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(self.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
        if len(self.first) + len(self.later) > REMEMBERED:
            self.first, self.later = {}, {}
        rows, first, later = split_texts(texts, self.first, self.later)
        self._learn(self.first, list(first), "")
        self._learn(self.later, list(later), " ")
        get = self.later.__getitem__
        return [self.first[row[0]] + sum(map(get, row[1:])) for row in rows]


def _whole(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(path)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_type), batch.column("n_bytes"), pa.array(counter.counts(texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """Rows (id, sha, k, n, start, text): chunk k of n begins at start; neighbours share `overlap` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "sha", "k", "n", "start", "chunk"]
        for batch in slices(batches, "text"):
            for row in batch.to_pylist():
                text, step = row["text"], chunk - overlap
                n = max(1, -(-(len(text) - overlap) // step))
                for k in range(0, n, 64):
                    some = range(k, min(n, k + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["id"]] * len(some), batch.schema.field("id").type), pa.array([row["sha"]] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array([n] * len(some), pa.int64()), pa.array([x * step for x in some], pa.int64()), pa.array([text[x * step : x * step + chunk] for x in some], pa.string())],
                        names,
                    )

    return run


def _encode(path: str, overlap: int, id_type: pa.DataType):
    """Rows (id, sha, seam, side, last, total, at, before): on each side of a seam the boundaries
    in the overlap and the tokens of the chunk before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = splicing_tokenizer(path)
        for batch in slices(batches, "chunk", 1_000_000):
            out: dict[str, list] = {c: [] for c in ("id", "sha", "seam", "side", "total", "at", "before")}

            def put(row, seam, side, total, at):
                for c, v in zip(out, (row["id"], row["sha"], seam, side, total, [p for p, _ in at], [t for _, t in at]), strict=True):
                    out[c].append(v)

            for row in batch.to_pylist():
                text, start, k, n = row["chunk"], row["start"], row["k"], row["n"]
                got = tokenizer.encode(text, add_special_tokens=False)
                words, at = got.word_ids, got.offsets
                begins = [(at[t][0] + start, t) for t in range(len(words)) if t == 0 or words[t] != words[t - 1]]
                if k > 0:
                    put(row, k - 1, "R", 0, [b for b in begins if b[0] < start + overlap])
                if k < n - 1:
                    end = start + len(text)
                    put(row, k, "L", 0, [b for b in begins[:-2] if end - overlap <= b[0] <= end - GUARD])
                else:
                    put(row, k, "E", len(words), [])
            kinds = (id_type, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32768, overlap_chars: int = 1024) -> DataFrame:
    """One row (id, n_bytes, n_tokens) for each row of docs.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows, and rows of one id
    with different texts, each give a row of their own; a null id stays null. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    Texts longer than chunk_chars are cut with overlap_chars, doubled where no stable
    boundary is found; tokenizers for which splicing isn't proven get whole texts.
    """
    if overlap_chars <= GUARD or chunk_chars < 2 * overlap_chars:
        raise ValueError("overlap_chars must exceed GUARD and be at most half of chunk_chars")
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = base.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow, sql = to_arrow_type(kind), kind.simpleString()
    sized = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted_whole = lambda some: some.mapInArrow(_whole(tokenizer_path, arrow), f"id {sql}, n_bytes bigint, n_tokens bigint")
    if splicing_tokenizer(tokenizer_path) is None:
        return counted_whole(sized).withColumnRenamed("id", id_col)
    short = counted_whole(sized.where(F.length("text") <= chunk_chars))
    long_rows = sized.where(F.length("text") > chunk_chars).withColumn("sha", F.sha2("text", 256))
    keys = ["id", "sha"]

    # so many tasks whatever the chunks weigh: tokenizing costs far more than moving them
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, pending, chunk, overlap = None, long_rows.select("id", "sha", "text"), chunk_chars, overlap_chars
    while True:
        chunks = pending.mapInArrow(_cut(chunk, overlap), f"id {sql}, sha string, k bigint, n bigint, start bigint, chunk string").repartition(tasks, "id", "sha", "k")
        sides = chunks.mapInArrow(_encode(tokenizer_path, overlap, arrow), f"id {sql}, sha string, seam bigint, side string, total bigint, at array<bigint>, before array<bigint>")
        # repeated rows give the same chunks: any one of them serves, and each seam counts once
        side = lambda s, c: F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True)
        seams = sides.groupBy(*keys, "seam").agg(side("L", "at").alias("l_at"), side("L", "before").alias("l_n"), side("R", "at").alias("r_at"), side("R", "before").alias("r_n"), side("E", "total").alias("total"))
        seams = seams.withColumn("p", F.array_min(F.array_intersect("l_at", "r_at")))
        pick = lambda at, n: F.element_at(n, F.array_position(at, F.col("p")).cast("int"))
        seams = seams.select(*keys, F.coalesce("total", F.when(F.col("p").isNotNull(), pick("l_at", "l_n") - pick("r_at", "r_n"))).alias("tokens"))
        per_text = written(seams.groupBy(*keys).agg(F.sum("tokens").alias("n_tokens"), F.count_if(F.col("tokens").isNull()).alias("failed")))
        right = per_text.where("failed = 0").select(*keys, "n_tokens")
        found = right if found is None else found.unionByName(right)
        failed = per_text.where("failed > 0").select(*keys)
        if failed.isEmpty():
            break
        overlap, chunk = overlap * 2, max(chunk, overlap * 4)
        pending = null_safe(long_rows.select("id", "sha", "text"), failed, keys, "left_semi")
    counted = null_safe(long_rows.drop("text"), found, keys).select("id", "n_bytes", "n_tokens")
    return short.unionByName(counted).withColumnRenamed("id", id_col)
