"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets are one node. Candidates are nodes whose SimHash fingerprints (of
the same shingles) are within 2 bits, found by Golay keys (see simhash), and nodes that
share the key of a band of MinHash values, as fingerprints of sets at 0.8 differ in some
ten bits; each candidate pair counts only if its sets, compared whole, reach 0.8. With 32 bands of 5 values a pair at 0.8 has no band in common with probability
(1 - 0.8 ** 5) ** 32, which is 3e-6, and a closer pair with less.

Keys that few nodes share give all their pairs. In keys that many share, nodes are
compared with one leader, another in each round, which joins what is alike at the
cost of a comparison a member. What is left then shares a key but is mostly unlike
(pages of one template). Such nodes are joined by prefixes, which is exact: sets in
one order of shingles, rare ones first, that reach 0.8 share one of their first few,
so early that what is left of both is enough. Shingles of a template are common, so
they stand too late in the order to make a pair. Pairs inside a component can add
nothing, so the components are those of all candidate pairs; a round's new links join
components as they are by then, and what is linked already isn't gone through again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bitmap, chunks, discard, in_bitmap, mix64, rolling, stash, texts
from .components import connected_components, leaders, text_key
from .simhash import fingerprint_links, majority

SHINGLE = 5
BANDS, BAND_ROWS = 32, 5
#: Nodes of one key up to which all its pairs are compared at once.
PAIR_LIMIT = 24
#: Rounds of leaders in keys that more nodes share.
ROUNDS = 3
#: Counters by which shingles of the nodes left over are put in order. Any order is right; a good one makes few pairs.
COUNTERS = 1 << 20


def shingle_set(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle, one without words none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(hashes.of(words), min(SHINGLE, len(words))))


def node_of(h: np.ndarray) -> int:
    """A set's name, as a signed number."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(h.tobytes(), 42) - (1 << 63)


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64))
    return seeds[::2, None], seeds[1::2, None] | np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    xor, times = _permutations()
    if len(h) * len(xor) <= 1 << 18:
        low = ((h ^ xor) * times).min(axis=1)
    else:
        low = np.array([((h ^ x) * t).min() for x, t in zip(xor[:, 0], times[:, 0], strict=True)], np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for value in low.reshape(BANDS, BAND_ROWS).T:
        key = mix64(key ^ value) + np.uint64(1)
    return key.view(np.int64)


def _sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, node, n, fp, keys, th) of each row; n is the size of the set, fp its fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            nodes, sizes, fps, keys = [], [], [], []
            for raw in texts(batch.column(1)):
                h = shingle_set(raw, hashes)
                nodes.append(node_of(h))
                sizes.append(len(h))
                fps.append(majority(h))
                keys.append(band_keys(h) if len(h) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "node", "n", "fp", "keys", "th"])

    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, node long, n long, fp long, keys array<long>, th long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, h array<long>) of the nodes wanted, one row each."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, "node", 24))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            found = {}
            for raw in texts(batch.column(1)):
                h = shingle_set(raw, hashes)
                node = node_of(h)
                if in_bitmap(bits.value, np.array([node], np.int64).view(np.uint64))[0]:
                    found[node] = h.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.list_(pa.int64()))], ["node", "h"])

    return rows.mapInArrow(scan, "node long, h array<long>").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach 0.8."""
    a, b = sets.toDF("a", "ha"), sets.toDF("b", "hb")
    both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return both.where("5 * i >= 4 * (size(ha) + size(hb) - i)").select("a", "b")


#: Sets of sizes so far apart can't reach 0.8.
_LIKE_SIZES = "5 * least(na, nb) >= 4 * greatest(na, nb)"


def _pairs(left: DataFrame, right: DataFrame, unlike: str) -> DataFrame:
    """Distinct pairs a < b that share a key; left (key, a, na, ..), right (key, b, nb, ..)."""
    both = left.join(right, "key").where(unlike).where(_LIKE_SIZES)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a < b of ``nodes`` (node, n, fp) by fingerprints: those of equal ones with the first of them, and the first of those within 2 bits."""
    worded = nodes.where("n > 0").select("node", "fp")
    first = stash(worded.groupBy("fp").agg(F.min("node").alias("first")), "first")
    same = worded.join(first, "fp").where("node <> first").select("node", "first")
    near = fingerprint_links(first.select("fp")).join(first.toDF("a", "node"), "a").join(first.toDF("b", "first"), "b").select("node", "first")
    return same.union(near).select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()


def _between(links: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (a, b) of nodes as links of their components; ``placed`` has (node, root) of all of them."""
    root_of = placed.select("node", "root").distinct()
    return links.join(root_of.toDF("a", "ra"), "a").join(root_of.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs a < b of ``nodes`` (node, n, root) of different roots among which are all whose sets reach 0.8.

    Of two such sets of n and m shingles at least 4 (n + m) / 9 are in both. With both
    in one order, the first that they share stands at a place with so many behind
    it, in both; so only the first n - ceil(0.8 n) + 1 of a set are looked at, and a
    shared one counts only if enough are left. Shingles that no other set has are
    left out.
    """
    held = sets.join(nodes, "node").select("node", "n", "root", "h")
    slots = held.select(F.explode("h").alias("h")).groupBy(F.pmod("h", F.lit(COUNTERS)).cast("int").alias("slot")).agg(F.count("*").alias("c")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[slots["slot"].to_numpy()] = slots["c"].to_numpy()
    share = nodes.sparkSession.sparkContext.broadcast(counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, owners = [], [], []
            ends = batch.column(3).offsets.to_numpy()
            values = batch.column(3).values.to_numpy()
            for i in range(batch.num_rows):
                h = values[ends[i] : ends[i + 1]]
                c = share.value[h % COUNTERS]
                first = np.lexsort((h, c))[: len(h) - -(-4 * len(h) // 5) + 1]
                known = np.nonzero(c[first] > 1)[0]
                tokens.append(h[first[known]])
                places.append(known)
                owners.append(np.full(len(known), i))
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *owners]))
            out = [batch.column(i).take(at) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), pa.array(np.concatenate([np.zeros(0, np.int64), *places]))], ["node", "n", "root", "key", "place"])

    tokens = stash(held.mapInArrow(scan, "node long, n long, root long, key long, place long"), "prefixes")
    tokens = tokens.join(tokens.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key")
    enough = "9 * least(na - pa, nb - pb) >= 4 * (na + nb)"
    return _pairs(tokens.toDF("key", "a", "na", "ra", "pa"), tokens.toDF("key", "b", "nb", "rb", "pb"), f"ra < rb and {enough}")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node long, component_id): components of texts linked at Jaccard 0.8 or more.

    ``component_id`` is the least doc_id of the component. Words are what ASCII white
    space separates, without regard to ASCII case; all texts without words (null ones
    among them) are one node. A null doc_id never is the least, and a component of
    nothing else has component_id null.
    """
    return _grouped(docs, id_col, text_col)[0].select("doc_id", "node", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """As ``near_copies``, with th and the component's root; and the tables that it reads."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(F.col(text_col)).alias("th"))
    sketched = stash(_sketches(rows), "sketches")
    nodes = stash(sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    alike = stash(_fingerprint_pairs(nodes), "alike")
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = stash(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "bands")
    members = stash(keys.join(shared, "key").select("key", "node", "n", (F.col("c") > PAIR_LIMIT).alias("hot")), "members")
    sets = stash(_sets(rows, members.select("node").union(alike.select("a")).union(alike.select("b")).distinct()), "sets")
    few, hot = members.where("not hot").drop("hot"), members.where("hot").drop("hot")
    pairs = _pairs(few.toDF("key", "a", "na"), few.toDF("key", "b", "nb"), "a < b").union(alike).distinct()
    links = stash(_close(pairs, sets), "links")
    roots = stash(connected_components(links), "roots")
    rooted = stash(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    if not hot.isEmpty():
        left, used = hot.join(rooted.select("node", "root"), "node").select("key", "node", "n", "root"), []
        for turn in range(ROUNDS + 1):
            split = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
            left = stash(left.join(split, "key", "left_semi"), "open")
            discard(*used)
            used = [left]
            if left.isEmpty():
                break
            if turn < ROUNDS:
                first = left.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", "key", F.lit(turn))).alias("s")).select("key", "s.*")
                pairs = _pairs(first.toDF("key", "a", "na", "ra"), left.toDF("key", "b", "nb", "rb"), "ra <> rb")
            else:
                pairs = _prefix_pairs(left.select("node", "n", "root").distinct(), sets)
            new = stash(_between(_close(pairs, sets), left), "between")
            if new.isEmpty():
                continue
            above = stash(connected_components(new).toDF("root", "above"), "above")  # a component of components, of few of them
            used += [rooted, new, above]
            rooted = stash(rooted.join(above, "root", "left").select("node", "least", F.coalesce("above", "root").alias("root")), "rooted")
            left = left.join(above, "root", "left").select("key", "node", "n", F.coalesce("above", "root").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    discard(alike, shared, members, sets, links, roots)
    return sketched.select("doc_id", "node", "th").join(rooted.join(lowest, "root").select("node", "component_id", "root"), "node"), [sketched, nodes]


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all its columns kept (see components.leaders)."""
    grouped, tables = _grouped(docs, id_col, text_col)
    found = stash(grouped.select("doc_id", "th", "root"), "found")
    discard(*tables)
    return leaders(docs, found, id_col, text_col)
