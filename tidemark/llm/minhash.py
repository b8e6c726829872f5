"""Document fingerprints by one-permutation MinHash, and their comparison with edited texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, chunks, mix64, rolling

BINS = 256
BITS = 4  # low-order bits kept of each bin
SHINGLE = 5


def sketch(words: np.ndarray, bins: int = BINS, shingle: int = SHINGLE) -> np.ndarray | None:
    """Word hashes to one hash for each bin; None for no words.

    All shingles are hashed once, the top bits choose the bin and the least hash
    in a bin stays. Empty bins are filled by optimal densification: each probes
    bins by a hash of its own number and the attempt until it meets a full one.
    """
    if not len(words):
        return None
    h = rolling(words, min(shingle, len(words)))
    shift = np.uint64(64 - (bins.bit_length() - 1))
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    where = (h >> shift).astype(np.int64)
    np.minimum.at(out, where, mix64(h))
    full = np.zeros(bins, bool)
    full[where] = True
    empty = np.nonzero(~full)[0]
    for row in probes(bins):
        if not len(empty):
            return out
        to = row[empty]
        hit = full[to]
        out[empty[hit]] = out[to[hit]]
        empty = empty[~hit]
    out[empty] = out[np.nonzero(full)[0][0]]  # after all rounds: chance below 2e-7 a bin even if one bin alone is full
    return out


@lru_cache(4)
def probes(bins: int, rounds: int = 4096) -> np.ndarray:
    """probes[t, i]: the bin that empty bin i asks at attempt t."""
    seed = (np.arange(rounds, dtype=np.uint64)[:, None] << np.uint64(32)) | np.arange(bins, dtype=np.uint64)
    return (mix64(seed + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)


def pack(mins: np.ndarray | None, bits: int = BITS) -> str:
    """The low-order bits of each bin in hexadecimal; no words: the empty string."""
    if mins is None:
        return ""
    low = (mins & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :].reshape(-1)).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated Jaccard similarity from low-order bits, less the chance agreement 2 ** -bits.

    Two empty texts are alike (1), an empty and another text are not (0).
    """
    if a is None or b is None:
        return float(a is b)
    mask, chance = np.uint64((1 << bits) - 1), 2.0**-bits
    same = float(np.mean((a & mask) == (b & mask)))
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


class Sketcher:
    def __init__(self) -> None:
        self.hashes = WordHashes()

    def __call__(self, text: str) -> np.ndarray | None:
        return sketch(self.hashes.of(text.encode().lower().split()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs``: MinHash of five-word shingles, ASCII lower case.

    Null and empty texts have the empty fingerprint; a text of fewer than five
    words is one shingle; equal texts have equal fingerprints.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Sketcher()
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(of(t or "")) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Bytes of text that a range of documents has, about, and how many ranges there are at most; beyond that they grow, and are sorted with spills.
RANGE_BYTES, RANGES = 32 << 20, 20_000
#: A document weighs one more for so many bytes when ranges are cut, and so many weights are looked at for each range.
WEIGHT_BYTES, SAMPLE = 1 << 12, 100


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each row of ``docs`` against its edited text and the next document (see COMPARED).

    Documents stand in order of doc_id, those of one doc_id by text; rows with a
    null doc_id come first, in the order of their texts' hashes. The edited text has
    its last quarter of code points replaced by the first as many of the next
    document, and the first document follows the last. Null and empty texts have no
    words. ``doc_id`` has to be of an integer type.

    Documents are cut into ranges of about equal bytes, each a partition of its own;
    a range starts at an id taken from a sample of the column (or, among null ids, at
    the least hash), and its first document goes to the range before it as well. So
    each text moves once, and no task holds more than a row and the one before it.
    Where the cuts lie changes no row. There are ``RANGES`` of them at most, whose
    first ids the plan holds.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be of an integer type to be in order")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    no_id, size = F.col("doc_id").isNull(), F.octet_length("text").cast("long")
    total = rows.agg(F.sum(size).alias("bytes"), F.sum(F.when(no_id, size)).alias("null_bytes"), F.min("doc_id").alias("least")).first()
    most = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = parts or min(max(int(most) * 2, -(-(total["bytes"] or 0) // RANGE_BYTES)), RANGES)
    bounds = []
    if total["least"] is not None:
        rate = min(1.0, SAMPLE * n / (1 + (total["bytes"] or 0) / WEIGHT_BYTES))
        times = F.floor(rate * (1 + F.expr(f"octet_length(text) / {WEIGHT_BYTES}")) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
        weighed = rows.where(~no_id).select(F.explode(F.array_repeat("doc_id", times.cast("int"))).alias("doc_id"))
        bounds = weighed.agg(F.percentile_approx("doc_id", [i / n for i in range(n)], 10 * n)).first()[0] or []
        bounds = sorted({*bounds} - {total["least"]})
    # ranges of null ids by hash, then ranges of ids
    nulls = 0 if total["null_bytes"] is None else parts or min(1 + total["null_bytes"] // RANGE_BYTES, RANGES)
    part = nulls + (_place(bounds)(F.col("doc_id")) if bounds else F.lit(0))
    rows = rows.withColumn("key", F.when(no_id, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    if nulls:
        part = F.when(no_id, F.least(F.lit(nulls - 1), F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * nulls).cast("int"))).otherwise(part)
    least = dict(tuple(r) for r in rows.where(no_id).groupBy(part.alias("p")).agg(F.min("key")).collect()) if nulls else {}  # a row for each range
    least |= {nulls + i: x for i, x in enumerate([total["least"], *bounds])} if total["least"] is not None else {}
    there = sorted(least)
    before = dict(zip(there, there[-1:] + there[:-1], strict=True))
    every = range(nulls + len(bounds) + 1)
    rows = rows.withColumn("part", part.cast("int"))
    first = F.get(_constants([least.get(p, 0) for p in every]), F.col("part")) == F.when(no_id, F.col("key")).otherwise(F.col("doc_id"))
    firsts = F.when(first, F.get(_constants([before.get(p, 0) for p in every]), F.col("part")))
    to = F.array_compact(F.array(F.struct("part", F.lit(0).alias("halo")), F.when(firsts.isNotNull(), F.struct(firsts.cast("int").alias("part"), F.lit(1).alias("halo")))))
    dealt = rows.withColumn("to", F.explode(to)).select(F.col("to.part").alias("part"), F.col("to.halo").alias("halo"), "doc_id", "text", "key")
    dealt = dealt.repartitionById(nulls + len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "halo", F.col("doc_id").asc_nulls_first(), "key", "text").drop("key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out, held = Sketcher(), [], None
        for batch in chunks(batches, "text"):
            part, halo, ids, body = (batch.column(i).to_pylist() for i in range(4))
            for p, extra, i, text in zip(part, halo, ids, body, strict=True):
                if held and held[0] == p:  # the row before, in this range
                    mins = of(text)
                    out.append(compare(of, held[1], held[2], held[3], text, mins))
                elif not extra:
                    mins = of(text)
                held = None if extra else (p, i, text, mins)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)
                out = []

    return dealt.mapInArrow(scan, COMPARED)


TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = [x.split()[0] for x in COMPARED.split(", ")]


def compare(of: Sketcher, doc_id: int, text: str, mins: np.ndarray | None, after: str, after_mins: np.ndarray | None) -> tuple:
    n = len(text)
    edited = text[: n - n // 4] + after[: n // 4]
    own = of(edited)
    return doc_id, n, sha256(edited.encode()).hexdigest(), pack(mins), pack(own), likeness(mins, own), likeness(mins, after_mins)


def _constants(values: list[int]) -> Column:
    """An array that the plan holds as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _place(bounds: list[int]):
    """The number of bounds at or below a value: a binary search in a constant array."""
    at = _constants(bounds)
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def expr(x) -> object:
        def half(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            below = (s["lo"] < s["hi"]) & (F.get(at, mid) <= x)
            return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), whole, half, lambda s: s["lo"])

    return expr
