"""Fill-in-middle transformation by rank and select over packed boundary bits.

The texts of a slice stand one after the other in an Arrow buffer. One bit for each byte
says whether a unit (a line with its end) ends there, another whether a code point
starts there. Both vectors are packed and have a directory of the ones before each block,
so that

* the number of units of a text is the difference of two ranks,
* the byte at which its k-th unit ends is one select,
* the code points between two bytes are the difference of two ranks again.

No line is ever put in a list, and all texts of a slice are cut at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import raw_bytes, slices

# fixed values: what stands before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
WORDS = 8


class Bits:
    """A packed bit vector with the number of ones before each block of WORDS words."""

    def __init__(self, flags: np.ndarray):
        block = 64 * WORDS
        packed = np.zeros((len(flags) // block + 1) * WORDS * 8, np.uint8)
        some = np.packbits(flags, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8").reshape(-1, WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position, which may be the vector's length."""
        block, word, bit = at // (64 * WORDS), at // 64 % WORDS, (at % 64).astype(np.uint64)
        counts = np.bitwise_count(self.words[block]) * (np.arange(WORDS) < word[:, None])
        below = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + counts.sum(axis=1, dtype=np.int64) + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the one that has k ones before it."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        ends = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (ends <= left[:, None]).sum(axis=1)
        left = left - np.where(word > 0, ends[np.arange(len(k)), word - 1], 0)
        bits = np.unpackbits(self.words[block, word].reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
        return (block * WORDS + word) * 64 + bit


def draws(ids: list, seed: str) -> np.ndarray:
    """Four numbers below 2**32 for each id: the first groups of the SHA-256 of seed:id."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").astype(np.int64).reshape(-1, 4)


def cuts(texts: pa.Array, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its number of units, the bytes at which prefix and middle end (in the slice's
    buffer), and the code points of both."""
    data, bounds = raw_bytes(texts)
    ends = data == 10
    ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
    units, chars = Bits(ends), Bits((data & 0xC0) != 0x80)
    before = units.rank(bounds)
    n = np.diff(before)
    drawn = drawn[:, :2] % (n[:, None] + 1)

    def byte(count):
        """Where the first `count` units of each text end."""
        at = bounds[:-1].copy()
        some = count > 0
        at[some] = units.select((before[:-1] + count - 1)[some]) + 1
        return at

    first, second = byte(drawn.min(axis=1)), byte(drawn.max(axis=1))
    start, one, two = chars.rank(bounds[:-1]), chars.rank(first), chars.rank(second)
    return n, first, second, one - start, two - one


def _transform(id_type: pa.DataType, seed: str, share: int, spm_share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            drawn = draws(batch.column("id").to_pylist(), seed)
            n, first, second, prefix, middle = cuts(texts, drawn)
            data, bounds = raw_bytes(texts)
            holds = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
            plain = holds.to_numpy(zero_copy_only=False) | (n == 0) | (drawn[:, 2] % 100 >= share)
            spm = drawn[:, 3] % 100 < spm_share
            p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
            whole, out = memoryview(data), []
            for a, b, c, d, same, turned in zip(bounds[:-1].tolist(), first.tolist(), second.tolist(), bounds[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
                if same:
                    out.append(bytes(whole[a:d]))
                elif turned:
                    out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
                else:
                    out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            columns = [batch.column("id").cast(id_type), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", share: int = 100, spm_share: int = 50) -> DataFrame:
    """One row (id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    A text's units are its lines, each with its line end. The numbers h1 to h4 of an id are
    the first four groups of eight hexadecimal digits of the SHA-256 of seed:id. The prefix
    ends after the smaller of h1 and h2 modulo n + 1 units, the middle after the larger.
    `share` percent of the texts (by h3) are turned, `spm_share` percent of these (by h4)
    into suffix-prefix-middle (spm), the others into prefix-suffix-middle (psm); empty
    texts and those that hold a marker stay plain, with null counts. A null text is empty;
    a null id draws as an empty one does; repeated rows, and rows of one id, each give a
    row; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    done = rows.mapInArrow(_transform(to_arrow_type(kind), seed, share, spm_share), f"id {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return done.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # what stands before the first marker is empty
    psm, spm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2)), F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
