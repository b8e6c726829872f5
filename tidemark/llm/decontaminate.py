"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The n-grams of all items are one sorted array of 64-bit hashes with where each
stands in the items' words; a training text's windows are looked up in it and each
hit is verified word by word. The set takes a few bytes for each byte of benchmark
text, so it is broadcast up to ``BROADCAST_BYTES`` of text. A larger benchmark isn't
broadcast: only a bitmap of bounded size is, and the windows that pass it are joined
to the n-grams. Both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, WordHashes, bitmap, chunks, in_bitmap, merged, rolling, stash, texts, unused

#: Bytes of benchmark text whose n-grams are broadcast, as five to eight times as many bytes.
BROADCAST_BYTES = 8 << 20
WORD = re.compile(rb"[^ ]+")
#: Bits of the bitmap that stands in for a larger benchmark (32 MB).
BITMAP_BITS = 28


def normal_words(text: bytes) -> list[bytes]:
    """ASCII-lower-case words of letters, digits and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; runs of different length don't meet."""
    return rolling(h, k) + np.uint64(k)


class GramIndex:
    """n-grams of benchmark items in arrays: words as one text, hashes, places, and the items of each n-gram."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        hashes, pieces, at, self.items = WordHashes(), [], 0, []
        starts, grams, places, owners, sizes = [], [], [], [], []
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            k = min(n, len(words))
            h = gram_hashes(hashes.of(words), k)
            grams.append(h)
            places.append(np.arange(at, at + len(h)))
            sizes.append(np.full(len(h), k))
            owners.append(np.full(len(h), len(self.items)))
            self.items.append(item)
            pieces += words
            at += len(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in pieces)])
        self.text, self.starts = b" ".join(pieces) + b" ", starts
        if not grams:
            self.lengths, self.hash = [], np.zeros(0, np.uint64)
            return
        grams, places, sizes, owners = map(np.concatenate, (grams, places, sizes, owners))
        self.lengths = np.unique(sizes).tolist()
        bodies = [self._body(p, k) for p, k in zip(places.tolist(), sizes.tolist(), strict=True)]
        order = sorted(range(len(grams)), key=lambda i: (grams[i], bodies[i], owners[i]))
        new = [j == 0 or grams[order[j - 1]] != grams[i] or bodies[order[j - 1]] != bodies[i] for j, i in enumerate(order)]
        firsts = np.nonzero(new)[0]
        order = np.array(order)
        self.hash, self.place, self.size = grams[order[firsts]], places[order[firsts]].astype(np.int32), sizes[order[firsts]].astype(np.int16)
        self.cut, self.owner = np.append(firsts, len(order)).astype(np.int32), owners[order].astype(np.int32)
        width = max(16, (16 * len(self.hash)).bit_length())
        self.bits = np.zeros(1 << (width - 6), np.uint64)
        slot = self.hash >> np.uint64(64 - width)
        np.bitwise_or.at(self.bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))

    def _body(self, place: int, k: int) -> bytes:
        return self.text[self.starts[place] : self.starts[place + k] - 1]

    def find(self, words: list[bytes], hashes: WordHashes) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word intervals that windows cover, and the items they are of."""
        h, starts, ends, grams = hashes.of(words), [], [], set()
        for k in self.lengths:
            x = gram_hashes(h, k)
            at = np.nonzero(in_bitmap(self.bits, x))[0]
            place = np.searchsorted(self.hash, x[at])
            for i, j in zip(at.tolist(), place.tolist(), strict=True):
                while j < len(self.hash) and self.hash[j] == x[i]:
                    if self.size[j] == k and self._body(self.place[j], k) == b" ".join(words[i : i + k]):
                        starts.append(i)
                        ends.append(i + k)
                        grams.add(j)
                        break
                    j += 1
        owners = {o for j in grams for o in self.owner[self.cut[j] : self.cut[j + 1]].tolist()}
        return merged(np.array(starts, np.int64), np.array(ends, np.int64)), {self.items[o] for o in owners}


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text): ids as strings, a null one empty; texts as bytes."""
    item = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    return benchmark.select(item.alias("item"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("text"))


def _annotate(docs: DataFrame, benchmark: DataFrame, n: int, at: int, item_col: str, item_text: str, finish: Callable, schema) -> DataFrame:
    """``finish`` (batch, list of (text, words, spans, items)) over all rows of ``docs``, whose column ``at`` is the text."""
    items, name = _items(benchmark, item_col, item_text), docs.columns[at]
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= BROADCAST_BYTES:
        index = docs.sparkSession.sparkContext.broadcast(GramIndex([(r.item, bytes(r.text)) for r in items.collect()], n))  # bounded by the sum just taken

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in chunks(batches, name):
                rows = []
                for text in texts(batch.column(at)):
                    words = normal_words(text)
                    rows.append((text, words, *index.value.find(words, hashes)))
                yield finish(batch, rows)

        return docs.mapInArrow(scan, schema)
    key, found = unused(docs, "key", "found")
    hits = _hits(docs, items, n, name).toDF(key, found)
    width = len(docs.columns)
    joined = docs.join(hits, _key(F.col(name)).eqNullSafe(F.col(key)), "left").select(*docs.columns, found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, name):
            rows = []
            for text, hit in zip(texts(batch.column(at)), batch.column(width).to_pylist(), strict=True):
                spans = merged([i for i, _ in hit["spans"]], [i + k for i, k in hit["spans"]]) if hit else []
                rows.append((text, normal_words(text), spans, set(hit["items"]) if hit else set()))
            yield finish(batch, rows)

    return joined.mapInArrow(merge, schema)


def _key(text: Column) -> Column:
    """What two rows of one text have in common: two hashes, 128 bits."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _hits(docs: DataFrame, items: DataFrame, n: int, text_col: str) -> DataFrame:
    """(key, found): of each text with hits, its windows (start, length) and item ids, by joins on n-grams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if words := normal_words(text):
                    k = min(n, len(words))
                    h = gram_hashes(hashes.of(words), k)
                    bodies = [b" ".join(words[i : i + k]) for i in range(len(h))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(h), pa.string()), pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(bodies, pa.binary())], ["item", "k", "h", "gram"])

    grams = stash(items.mapInArrow(cut, "item string, k int, h long, gram binary").distinct(), "grams")
    lengths = [r.k for r in grams.select("k").distinct().collect()]  # n at most
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(grams, "h", BITMAP_BITS))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            seen, out = set(), []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                words = normal_words(text)
                h = hashes.of(words)
                for k in lengths:
                    x = gram_hashes(h, k)
                    out += [(a, b, i, k, int(x[i : i + 1].view(np.int64)[0]), b" ".join(words[i : i + k])) for i in np.nonzero(in_bitmap(bits.value, x))[0].tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "b", "i", "k", "h", "gram"])

    rows = docs.select(_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("key.a", "key.b", "text")
    seen = rows.mapInArrow(look, "a long, b long, i int, k int, h long, gram binary").distinct()
    hit = stash(seen.join(grams.select("k", "h", "gram").distinct(), ["k", "h", "gram"], "left_semi"), "hits")
    spans = hit.groupBy("a", "b").agg(F.collect_set(F.array("i", "k")).alias("spans"))
    which = hit.select("a", "b", "k", "h", "gram").distinct().join(grams, ["k", "h", "gram"]).groupBy("a", "b").agg(F.collect_set("item").alias("items"))
    return spans.join(which, ["a", "b"]).select(F.struct("a", "b").alias("key"), F.struct("spans", "items").alias("found"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted strings), spans (word intervals).

    A window is ``n`` words of an item in a row, or all its words if it has fewer.
    Null and empty texts have no words and no hits; items without words have no
    windows; items of the same text all count; a null item_id is the empty string.
    Ids may be of any type.
    """

    def finish(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(w) for _, w, _, _ in rows], pa.int64()), pa.array([sum(b - a for a, b in s) for _, _, s, _ in rows], pa.int64()),
            pa.array([sorted(i) for *_, i in rows], pa.list_(pa.string())), pa.array([[list(x) for x in s] for _, _, s, _ in rows], pa.list_(pa.list_(pa.int64()))),
        ], ["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return _annotate(rows, benchmark, n, 1, item_col, "text", finish, f"doc_id {kind}, n_words long, n_hit long, item_ids array<string>, spans array<array<long>>")


def digest_items(items: list[str]) -> str:
    return sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` with the words of hit spans cut out of the text; all columns stay.

    Rows in which more than ``drop_share`` of the words are hit are removed
    (0: every row with a hit). Rows without a hit, null texts among them, are
    returned as they are.
    """
    own = docs.columns
    at = own.index(text_col)

    def finish(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        old = batch.column(at)
        out, keep = old.to_pylist() if any(s for _, _, s, _ in rows) else None, []
        for i, (text, words, spans, _) in enumerate(rows):
            hit = sum(b - a for a, b in spans)
            keep.append(hit == 0 or hit <= drop_share * len(words))
            if hit and keep[-1]:
                where = [m.span() for m in WORD.finditer(text.translate(WORD_TABLE))]
                parts, done = [], 0
                for a, b in spans:
                    parts.append(text[done : where[a][0]])
                    done = where[b - 1][1]
                out[i] = b"".join([*parts, text[done:]]).decode()
        columns = [batch.column(j) if j != at or out is None else pa.array(out, old.type) for j in range(len(own))]
        return pa.RecordBatch.from_arrays(columns, own).filter(pa.array(keep))

    return _annotate(docs, benchmark, n, at, item_col, "text", finish, docs.schema)
