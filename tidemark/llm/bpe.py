"""Byte-level BPE: texts to token ids by merges in padded matrices, and ids back to bytes."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

VOCABULARY = path("byte_bpe_multi_50k.tiktoken")
#: Bytes up to which a piece is a row of a matrix; longer ones merge one by one through a heap, as rounds of long rows cost the square of the length.
ROW_BYTES = 512
#: Cells of one matrix, and bytes of pieces and ids that a worker remembers.
CELLS, REMEMBERED = 1 << 20, 64 << 20

NONE = np.int32(np.iinfo(np.int32).max)
FREE, SPREAD = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)


def newer_characters(pattern: str) -> str:
    """Characters that ``regex`` classes as letters or numbers and the tokenizer library, built with older Unicode tables, doesn't."""
    import regex
    import tiktoken

    classes = [c for c in (r"\p{L}", r"\p{N}") if c in pattern]
    single = {bytes([i]): i for i in range(256)}
    unknown = "".join(c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    out = []
    for cls in classes:
        known = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=single, special_tokens={})
        out += [c for c in regex.findall(cls, unknown) if not known.encode_ordinary(c)]
    return "".join(out)


class Vocabulary:
    """Ranks of byte strings (a token's id is its rank), and the pairs of tokens that merge, in a hash table of open addressing.

    A pair merges if its joined bytes are a token; the rank of that token says how
    early. The table holds every way to cut a token in two, at most half full.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern, self.newer = pattern, newer_characters(pattern)
        tokens = sorted(ranks, key=ranks.__getitem__)
        ids = np.array([ranks[t] for t in tokens], np.int64)
        self.size = int(ids[-1]) + 1
        self.lengths = np.full(self.size, -1, np.int64)
        self.lengths[ids] = [len(t) for t in tokens]
        self.starts = np.concatenate([[0], np.cumsum(np.maximum(self.lengths, 0))])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, value = np.array(pairs, np.uint64).reshape(-1, 3).T
        self._insert(left << np.uint64(32) | right, value.astype(np.int32))
        self._memory: dict[str, bytes] = {}
        self._held = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": {}, "_held": 0}

    @classmethod
    @lru_cache(4)
    def read(cls, file: str, pattern: str = PATTERN) -> Vocabulary:
        with open(file, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(len(keys), 4).bit_length() + 1
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, FREE), np.full(1 << bits, NONE)
        slot = ((keys * SPREAD) >> self.shift).astype(np.int64)
        while len(keys):  # of those that meet in a free slot one gets it, the others go on
            free = self.keys[slot] == FREE
            self.keys[slot[free]] = keys[free]
            put = free & (self.keys[slot] == keys)
            self.values[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & self.mask

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair of ids merges to, NONE if it doesn't."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = ((key * SPREAD) >> self.shift).astype(np.int64)
        out, todo = np.full(len(key), NONE), np.arange(len(key))
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != FREE)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
        return out

    def merged_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of similar length, packed: a row each, padded to the longest.

        In a round every row that still has a pair to merge merges the leftmost of
        least rank and closes the gap, so rows and matrix get shorter by one
        together; rows without such a pair leave.
        """
        out: list[bytes] = [b""] * len(pieces)
        rows, lengths = np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), lengths.max(initial=1)), self.size, np.int32)  # the size is no id: it pads, and merges with nothing
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.merges(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            live = best != NONE
            for i in np.nonzero(~live)[0]:
                out[rows[i]] = ids[i, : lengths[i]].astype("<u4").tobytes()
            if not live.all():
                rows, lengths, ids, rank, at, best = rows[live], lengths[live], ids[live], rank[live], at[live], best[live]
            if not len(rows):
                break
            each, width = np.arange(len(rows)), ids.shape[1] - 1
            ids[each, at] = best
            column = np.arange(width)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            rank = np.take_along_axis(rank, column[:-1] + (column[:-1] >= at[:, None]), 1)
            lengths = lengths - 1
            for place in (at - 1, at):  # the pairs on both sides of the new token
                inside = (place >= 0) & (place < width - 1)
                r, c = each[inside], place[inside]
                rank[r, c] = self.merges(ids[r, c], ids[r, c + 1])
        return out

    def merged_long(self, piece: bytes) -> bytes:
        """As ``merged_rows``, for one long piece: a heap of (rank, place) over linked places."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.merges(ids[:-1], ids[1:])
        n = len(piece)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        at = np.nonzero(rank != NONE)[0]
        heap = list(zip(rank[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        pair: list[int | None] = [None if r == NONE else r for r in rank.tolist()] + [None]
        known: dict[tuple[int, int], int | None] = {}
        while heap:
            r, i = heapq.heappop(heap)
            if pair[i] != r:
                continue
            j = after[i]
            ids[i], pair[j], after[i] = r, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            ids[j] = -1
            for a in (before[i], i):
                if a < 0:
                    continue
                b = after[a]
                if b >= n:
                    pair[a] = None
                    continue
                key = ids[a], ids[b]
                if key not in known:
                    found = self.merges(np.array([key[0]]), np.array([key[1]]))[0]
                    known[key] = None if found == NONE else int(found)
                pair[a] = known[key]
                if pair[a] is not None:
                    heapq.heappush(heap, (pair[a], a))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, packed, by matrices of pieces of like length."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        least, most = 0, 4
        while least < ROW_BYTES:
            at = np.nonzero((lengths > least) & (lengths <= most))[0]
            step = max(CELLS // most, 1)
            for i in range(0, len(at), step):
                block = at[i : i + step].tolist()
                for k, ids in zip(block, self.merged_rows([pieces[k] for k in block]), strict=True):
                    out[k] = ids
            least, most = most, min(most * 2, ROW_BYTES) if most < ROW_BYTES else most + 1
        for k in np.nonzero(lengths > ROW_BYTES)[0].tolist():
            out[k] = self.merged_long(pieces[k])
        return out

    def encoder(self):
        """Function from a list of texts to their packed ids. Pieces are remembered up to a bound in bytes."""
        import regex

        rx = regex.compile(self.pattern)
        newer, hidden = frozenset(self.newer), dict.fromkeys(map(ord, self.newer), "\ufffd")

        def pieces(text: str) -> list[str]:
            if text.isascii() or newer.isdisjoint(text):
                return rx.findall(text)
            return [text[a:b] for a, b in (m.span() for m in rx.finditer(text.translate(hidden)))]

        def encode(batch: list[str]) -> list[bytes]:
            if self._held > REMEMBERED:
                self._memory.clear()
                self._held = 0
            cut = [pieces(t) for t in batch]
            fresh = list({p for ps in cut for p in ps if p not in self._memory})
            for p, ids in zip(fresh, self.merged([p.encode() for p in fresh]), strict=True):
                self._memory[p] = ids
                self._held += len(p) + len(ids) + 100
            return [b"".join(map(self._memory.__getitem__, ps)) for ps in cut]

        return encode

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids; an id that isn't in the vocabulary is an error."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if len(ids) and (ids.max() >= self.size or (self.lengths[ids] < 0).any()):
            raise ValueError(f"{ids[(ids >= self.size) | (self.lengths[np.minimum(ids, self.size - 1)] < 0)][0]} is no id of the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.bytes[at].tobytes()


def _column(batch: pa.RecordBatch, i: int) -> list:
    return batch.column(i).to_pylist()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens long, ids binary (little-endian unsigned 32-bit integers, as in token files).

    Every match of ``pattern`` is encoded for itself, without special tokens. Null
    texts count as empty and have no ids; ids may be of any type, null or repeated.
    The vocabulary is read on the driver and broadcast.
    """
    share = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path, pattern))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = share.value.encoder()
        for batch in chunks(batches, "text"):
            ids = coded(_column(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids binary")


def decode(coded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """``coded`` with the bytes of its packed ids in place of them, as ``out_col`` binary; null ids have no bytes.

    Bytes need not be UTF-8: ids may end within a character. An id that the
    vocabulary doesn't have is an error.
    """
    share = coded.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary_path))
    at = coded.columns.index(ids_col)
    names = [out_col if c == ids_col else c for c in coded.columns]
    schema = ", ".join(f"`{name}` {'binary' if c == ids_col else kind}" for name, (c, kind) in zip(names, coded.dtypes, strict=True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, ids_col):
            plain = pa.array([share.value.decode(x or b"") for x in _column(batch, at)], pa.binary())
            yield pa.RecordBatch.from_arrays([plain if i == at else c for i, c in enumerate(batch.columns)], names)

    return coded.mapInArrow(scan, schema)
