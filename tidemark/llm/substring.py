"""Removal of long repeated passages: winnowed anchors as seeds, extended both ways.

Each window of ``length`` words chooses one of its k-grams, the leftmost of least
hash, as its anchor; equal windows choose equal anchors at equal places. So a
window can only repeat where its anchor repeats:

1. a scan counts anchors, summed before they are shuffled;
2. a second scan takes every occurrence of a repeated anchor with the windows that
   chose it, from the one that reaches farthest left to the one that reaches
   farthest right. Repeats inside one scan step are settled there, and only one
   witness of each goes on;
3. occurrences meet by anchor. A match is extended left and right of the anchor as
   far as the windows around it agree, which a comparison of their rolling hashes
   tells for all alignments at once and for all occurrences of a group by one sort,
   without pairs. An anchor that occurs more than ``HOT_ROWS`` times is dealt window
   by window instead, so no group grows with the corpus: a cold one has that many
   rows at most, a hot window one for each scan step of 16 MB;
4. window starts that repeat are gathered for each document, joined to maximal
   repeats and cut from the text.

Anchors and windows are compared by two independent 64-bit hashes, 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bitmap, chunks, in_bitmap, merged, mix64, rolling, stash, texts

LENGTH = 35
#: Occurrences of an anchor that meet in one group.
HOT_ROWS = 2_000
#: Rows of one group that a task holds before it settles what it can of them.
HELD_ROWS = 20_000
FLAT = ", th long, route long, anchor long, lo int, n int, windows binary"


def winnow(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes to (anchor hash, anchor position) of each window of ``length`` words."""
    k = length // 2 + 1
    grams = rolling(x, k)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones is least
    w, span = length - k + 1, 1
    while span * 2 <= w:
        order = np.minimum(order[:-span], order[span:])
        span *= 2
    if w > span:
        order = np.minimum(order[: span - w], order[w - span :])
    at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return grams[at], at


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def repeated_anchors(rows: DataFrame, length: int) -> DataFrame:
    """(h long, n long): anchors that occur twice or more, with how often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text", 16 << 20):
            found = []
            for text in texts(batch.column(0)):
                words = text.split()
                if len(words) >= length:
                    h, at = winnow(hashes.of(words), length)
                    found.append(h[np.concatenate([[True], at[1:] != at[:-1]])])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counted = rows.select("text").mapInArrow(scan, "h long, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def _extend(length: int, bits, hot) -> object:
    """Scan (doc_id, text, th) to the windows of repeated anchors, a row for each anchor occurrence.

    Rows without ``windows`` are settled: they give runs of starts of one document.
    Rows with ``n`` < 0 are witnesses, which no document waits for.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text", 16 << 20):
            doc, start, anchor, window = [], [], [], []
            for i, text in enumerate(texts(batch.column(1))):
                words = text.split()
                if len(words) < length:
                    continue
                x = hashes.of(words)
                h, _ = winnow(x, length)
                at = np.nonzero(in_bitmap(bits.value, h))[0]
                if len(at):
                    doc.append(np.full(len(at), i))
                    start.append(at)
                    anchor.append(h[at])
                    window.append(rolling(x, length)[at])
            if not doc:
                continue
            doc, start, anchor, window = map(np.concatenate, (doc, start, anchor, window))
            order = np.argsort(window, kind="stable")
            same = window[order[1:]] == window[order[:-1]]
            same &= anchor[order[1:]] == anchor[order[:-1]]
            known = np.zeros(len(window), bool)
            known[order[1:][same]] = True
            witness = order[:-1][same & ~known[order[:-1]]]  # the first of each repeated window
            known[order[:-1][same]] = True
            ids = (batch.column(0), batch.column(2))
            yield from _settled(ids, doc[known], start[known])
            yield from _pending(ids, doc[~known], start[~known], anchor[~known], window[~known], hot.value, 1)
            yield from _pending(ids, doc[witness], start[witness], anchor[witness], window[witness], hot.value, -1)

    return scan


def _cut(*same: np.ndarray) -> np.ndarray:
    """Starts of runs in which all the arrays given go on."""
    return np.concatenate([[0], np.nonzero(~np.logical_and.reduce(same))[0] + 1])


NAMES = ["doc_id", "th", "route", "anchor", "lo", "n", "windows"]


def _batch(ids, doc, route, anchor, lo, n, windows) -> pa.RecordBatch:
    who = pa.array(doc)
    return pa.RecordBatch.from_arrays([ids[0].take(who), ids[1].take(who), pa.array(route.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), windows], NAMES)


def _settled(ids, doc, start) -> Iterator[pa.RecordBatch]:
    if len(doc):
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        at = _cut(doc[1:] == doc[:-1], start[1:] == start[:-1] + 1)
        n = np.diff(np.append(at, len(doc)))
        spread = mix64(start[at].astype(np.uint64) + (doc[at].astype(np.uint64) << np.uint64(32)))
        yield _batch(ids, doc[at], spread, spread, start[at], n, pa.nulls(len(at), pa.binary()))


def _pending(ids, doc, start, anchor, window, hot: np.ndarray, sign: int) -> Iterator[pa.RecordBatch]:
    """Occurrences of anchors with their windows; ``hot`` is a bitmap of anchors whose windows go alone."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start, anchor, window = (v[order] for v in (doc, start, anchor, window))
    is_hot = in_bitmap(hot, anchor)
    at = _cut(doc[1:] == doc[:-1], start[1:] == start[:-1] + 1, anchor[1:] == anchor[:-1], ~is_hot[1:])
    n = np.diff(np.append(at, len(doc)))
    route = np.where(is_hot[at], mix64(anchor[at] ^ window[at]), anchor[at])
    offsets = pa.array(np.append(at, len(doc)).astype(np.int32) * 8).buffers()[1]
    data = pa.py_buffer(np.ascontiguousarray(window))
    windows = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, data])
    yield _batch(ids, doc[at], route, anchor[at], start[at], n * sign, windows)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their routes to runs (doc_id, th, lo, n) of window starts that repeat.

    No more than a batch and the group that goes on after it is held.
    """
    held = None
    for batch in batches:
        settled = np.asarray(batch.column(6).is_null())
        if settled.any():
            done = batch.filter(pa.array(settled))
            yield pa.RecordBatch.from_arrays([done.column(j) for j in (0, 1, 4, 5)], RUN)
            batch = batch.filter(pa.array(~settled))
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        route = rows.column(2).to_numpy()
        cut = int(np.nonzero(route != route[-1])[0][-1]) + 1 if route[0] != route[-1] else 0
        if cut:
            yield from _repeated(rows.slice(0, cut))[0]
        held = rows.slice(cut)
        if held.num_rows > HELD_ROWS:
            runs, held = _repeated(held)
            yield from runs
    if held is not None and held.num_rows:
        yield from _repeated(held)[0]


RUN = ["doc_id", "th", "lo", "n"]


def _repeated(rows: pa.RecordBatch) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
    """(runs that repeat among the rows, rows that still have to meet others of their group).

    Of windows that repeat one witness has to; rows that consist of such windows
    alone are done with otherwise.
    """
    anchor, lo, n = (rows.column(j).to_numpy() for j in (3, 4, 5))
    count = np.abs(n).astype(np.int64)
    column = rows.column(6)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    window = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
    row = np.repeat(np.arange(len(count)), count)
    who = anchor.view(np.uint64)[row]
    order = np.argsort(window, kind="stable")
    # equal windows stand together; in them, equal anchors too but for a collision, which a sort by both settles
    same = window[order[1:]] == window[order[:-1]]
    if (who[order[1:]][same] != who[order[:-1]][same]).any():
        order = np.lexsort((who, window))
        same = window[order[1:]] == window[order[:-1]]
    same &= who[order[1:]] == who[order[:-1]]
    later, twice = np.zeros(len(window), bool), np.zeros(len(window), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    open_rows = np.unique(row[~later])  # with a window that is new here, or the first of its kind
    left = rows.take(pa.array(open_rows))
    at = np.nonzero(twice & (n[row] > 0))[0]  # witnesses have been settled where they were found
    if not len(at):
        return [], left
    first = np.cumsum(count) - count
    start = lo[row[at]] + (at - first[row[at]])
    cut = _cut(row[at][1:] == row[at][:-1], start[1:] == start[:-1] + 1)
    length = np.diff(np.append(cut, len(at)))
    pick = pa.array(row[at][cut])
    return [pa.RecordBatch.from_arrays([rows.column(0).take(pick), rows.column(1).take(pick), pa.array(start[cut].astype(np.int32)), pa.array(length.astype(np.int32))], RUN)], left


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, lo, n): runs of ``n`` windows from word ``lo`` on that repeat elsewhere; th is xxhash64 of the text."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    anchors = stash(repeated_anchors(rows, length), "anchors")
    # The bitmaps have a fixed bound; beyond it they let more anchors through, which costs shuffling and changes nothing.
    bits = spark.sparkContext.broadcast(bitmap(anchors, "h", min(28, max(20, (16 * anchors.count()).bit_length()))))
    hot = spark.sparkContext.broadcast(bitmap(anchors.where(F.col("n") > HOT_ROWS), "h", 24))
    extended = rows.mapInArrow(_extend(length, bits, hot), f"doc_id {kind}{FLAT}")
    return extended.repartition("route").sortWithinPartitions("route").mapInArrow(_match, f"doc_id {kind}, th long, lo int, n int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (text), kept_sha256.

    A word goes if a window of ``length`` words over it starts elsewhere as well,
    in the same document or another, repeated rows included; what stays is
    joined by single spaces. Null texts have no words; texts of fewer words than
    a window lose none. Ids may be of any type.
    """
    return _removed(docs, length, id_col, text_col, True)


def _removed(docs: DataFrame, length: int, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    runs = repeats(docs, length, id_col, text_col)
    runs = runs.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "n")).alias("runs")).toDF("__id", "__th", "runs")
    rows = _rows(docs, id_col, text_col)
    both = rows.join(runs.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(runs["__id"]) & (rows["th"] == runs["__th"]), "left").select("doc_id", "text", "runs")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words_n, gone_n, kept_all, digest = [], [], [], []
            runs = batch.column(2)
            flat = runs.flatten()
            lo, n = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(2)) if len(flat) else (np.zeros(0, np.int64),) * 2
            at = 0
            for text, size in zip(texts(batch.column(1)), _sizes(runs), strict=True):
                words = text.split()
                kept, done = words, 0
                if size:
                    kept = []
                    for a, b in merged(lo[at : at + size], lo[at : at + size] + n[at : at + size] + (length - 1)):
                        kept += words[done:a]
                        done = b
                    kept += words[done:]
                    at += size
                body = b" ".join(kept)
                words_n.append(len(words))
                gone_n.append(len(words) - len(kept))
                digest.append(sha256(body).hexdigest())
                kept_all.append(body.decode() if with_text else None)
            columns = [batch.column(0), pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept_all, pa.string())] if with_text else columns, [*names, "kept"] if with_text else names)

    return both.mapInArrow(scan, f"doc_id {dict(both.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def _sizes(lists: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(lists), 0).to_pylist()


def removal_report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``remove_repeats``, without the text that stays."""
    return _removed(docs, length, id_col, text_col, False)
