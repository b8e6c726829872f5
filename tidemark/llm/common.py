"""Helpers that the text operators share: shared storage, Arrow chunking, bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trees import discard, written

#: Bytes of text that one step of an Arrow scan holds at once (a longer text stands alone).
CHUNK_BYTES = 4 << 20

#: Maps UTF-8 bytes to ASCII-lower-case letters, digits and bytes of non-ASCII characters; the rest to a space.
WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (``spark.checkpoint.dir``) and read it back.

    This cuts lineage, fixes values that would differ on recomputation, and
    survives the loss of executors. The table is removed when Python exits, or
    by ``discard`` before.
    """
    return written(df, name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, close to the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, keys: list, part: str, place: str, name: str) -> DataFrame:
    """``df`` written in ranges of ``keys``, with the number of a row's range and its place in the order of all rows.

    Places grow along the order and leave gaps between ranges only. Where ranges
    are cut depends on Spark's sample, so only differences inside a range and
    counts of whole ranges mean anything. No row is moved more than once.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    return stash(dealt.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33).cast("int")), name)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``limit`` bytes of text at most."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        step = np.cumsum(sizes) // limit
        cuts = [0, *(np.nonzero(np.diff(step))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


class WordHashes(dict):
    """Word to 64-bit hash, computed once for each word in a while.

    The table is emptied when it has grown to ``limit`` words.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxh64_intdigest(word, 42)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values of ``x``, in O(log k) passes (length len(x) - k + 1)."""
    base, full = 0x9E3779B97F4A7C15, 1 << 64
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.zeros(n, np.uint64), 0
    power, span = x, 1  # power[i]: hash of the span values from i
    while span <= k:
        if k & span:
            out = out + np.uint64(pow(base, done, full)) * power[done : done + n]
            done += span
        if span * 2 <= k:
            power = power[:-span] + np.uint64(pow(base, span, full)) * power[span:]
        span *= 2
    return mix64(out)


def bitmap(df: DataFrame, column: str, bits: int = 27) -> np.ndarray:
    """A set of 64-bit hashes as a bitmap of ``2 ** bits`` bits, on the driver.

    Its size has that bound whatever the input; it has no false negatives, and
    more false positives the more hashes there are. Words of the bitmap are
    or-ed together on the executors.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (
        df.select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned({column}, {64 - bits}), 64) as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    table = words.toArrow()
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    width = int(bits.size).bit_length() - 1 + 6
    slot = h >> np.uint64(64 - width)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Intervals sorted by start, with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(int(a), int(b)) for a, b in out]


__all__ = ["WordHashes", "bitmap", "chunks", "discard", "in_bitmap", "merged", "mix64", "numbered", "rolling", "stash", "texts", "unused"]
