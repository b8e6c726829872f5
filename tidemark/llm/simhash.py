"""Near duplicates by SimHash, with candidates from Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of at most 22 bits. The perfect binary
Golay code [23, 12, 7] sends each padded segment to the indices of all codewords
within distance 4 (one or six of them). Two segments that differ in two bits or
fewer always have such a codeword in common: if their nearest codewords differ,
both lie at distance 3, and the unique block of the Steiner system S(4, 7, 23)
through the error positions and one differing bit gives a codeword within 4 of
both. Pigeonhole over segments makes keys of several segments:

* total errors up to 2: one of three segments is exact and the next has at most 2
  errors, so the key is (exact segment, codeword index), about 33 bits.

Keys that few fingerprints share are joined and each pair verified. Keys that
many share go another exact way, without pairs: two fingerprints are within 2
bits just if the balls of radius 1 around them meet, so fingerprints are dealt to
their 65 ball points, each of which can hold 65 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stash, texts
from .components import connected_components, leaders, text_key

GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
#: Fingerprints of one key up to which all its pairs are compared; beyond it the ball way is taken.
PAIR_LIMIT = 48
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, bits


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    v = v.astype(np.uint32)
    for bit in range(22, 10, -1):
        v = v ^ (((v >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11)))
    return v


@lru_cache(1)
def near_codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight up to 4, nearest first, and how many."""
    from itertools import combinations

    patterns = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(23), w)], np.uint32)
    table, count = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for p, s in zip(patterns.tolist(), syndrome(patterns).tolist(), strict=True):
        table[s, count[s]] = p
        count[s] += 1
    return table, count


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within 4 of each segment, and a mask of those in use."""
    table, count = near_codewords()
    s = syndrome(segment)
    return (segment.astype(np.uint32)[:, None] ^ table[s]) >> np.uint32(11), np.arange(6) < count[s][:, None]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs: any two fingerprints within 2 bits share a key."""
    seg = [(fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1) for shift, bits in SEGMENTS]
    keys, rows = [], []
    for i in range(3):
        index, used = codeword_indices(seg[(i + 1) % 3])
        key = np.uint64(i << 34) | (seg[i] << np.uint64(12))[:, None] | index.astype(np.uint64)
        row, col = np.nonzero(used)
        keys.append(key[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def simhash(words: list[bytes], shingle: int = 3) -> int:
    """SimHash of word shingles under XXH64 (seed 42); no words: 0."""
    from xxhash import xxh64_intdigest

    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - shingle]]).tolist()
    parts = map(joined.__getitem__, map(slice, starts, (ends[shingle - 1 :] - 1).tolist()))
    m = n - shingle + 1
    return majority(np.fromiter(map(partial(xxh64_intdigest, seed=42), parts), np.dtype("<u8"), m))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: bits that over half of them have; 0 for none."""
    m, h = len(hashes), hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if m < 300:
        sums = np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        sums = np.concatenate([np.bincount(h[:, j], minlength=256) @ _byte_bits() for j in range(8)])
    return int(np.packbits(sums * 2 > m, bitorder="little").view("<u8")[0])


@lru_cache(1)
def _byte_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (doc_id, fp long) for each row of ``docs``; null texts count as empty (fp 0)."""
    return _fingerprints(docs, id_col, text_col, shingle).select("doc_id", "fp")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """As ``fingerprints``, with th (see components.text_key)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            fps = np.array([simhash(t.lower().split(), shingle) for t in texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["id", "fp", "th"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("th"))
    return rows.mapInArrow(scan, f"id {dict(rows.dtypes)['id']}, fp long, th long").toDF("doc_id", "fp", "th")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) whose closure joins all pairs within 2 bits.

    Every such pair is either returned or joined through others that are.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(fp), 50_000):
                part = fp[a : a + 50_000]
                key, row = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))], ["key", "fp"])

    keys = fps.mapInArrow(emit, "key long, fp long")
    shared = stash(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "golay")
    two = shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    few = keys.join(shared.where(f"n > 2 and n <= {PAIR_LIMIT}").select("key"), "key")
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").select("a", "b")
    close = two.union(pairs).where("bit_count(a ^ b) <= 2").distinct()
    many = keys.join(shared.where(f"n > {PAIR_LIMIT}").select("key"), "key", "left_semi").select("fp").distinct()
    points = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("p"))
    balls = points.groupBy("p").agg(F.collect_set("fp").alias("s")).where("size(s) > 1")  # 65 at most
    stars = balls.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where("a <> b").distinct()
    return close.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): components of fingerprints linked at 2 bits or fewer.

    ``component_id`` is the least doc_id of the component. Equal fingerprints are
    one node, so copies never make pairs. Null texts are empty texts (fingerprint
    0); repeated rows are returned as often as they come; a null doc_id never is
    the least, and a component of nothing else has component_id null. Ids may be of
    any type that Spark sorts.
    """
    return _grouped(docs, id_col, text_col, shingle).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """As ``near_duplicates``, with th and the component's root."""
    rows = stash(_fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "th", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all its columns kept (see components.leaders)."""
    return leaders(docs, stash(_grouped(docs, id_col, text_col, 3), "found"), id_col, text_col)
