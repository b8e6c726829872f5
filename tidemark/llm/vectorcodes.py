"""Product codes of vectors: codebooks of integer entries, nearest entries by annular norm pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Pairs of a part and an entry whose distance is computed at once.
PAIRS = 1 << 19
#: Labels up to which their sums are broadcast.
BROADCAST_LABELS = 100_000
#: Copies of a label's sum, for labels that hold many rows, where sums are joined.
SALTS = 16


class Annuli:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.columns = norms[self.order], np.ascontiguousarray(entries[self.order].T)

    def _keys(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance and index in one number each, so that the least has the lower index of equal distances."""
        total = np.zeros(len(row), np.int64)
        for mine, its in zip(x, self.columns, strict=True):
            gap = mine[row] - its[at]
            total += gap * gap
        return total * len(self.order) + self.order[at]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for columns ``x`` (components first), exactly.

        The entries next to a part's own norm give a first distance r. An entry
        nearer than r has a norm within r of the part's own; that interval is found
        by binary search, with its ends and room for rounding, and all of it is
        computed.
        """
        n, k = x.shape[1], len(self.order)
        own = np.sqrt((x.astype(np.float64) ** 2).sum(0))
        every = np.arange(n)
        at = np.searchsorted(self.norms, own)
        best = np.minimum(self._keys(x, every, np.clip(at - 1, 0, k - 1)), self._keys(x, every, np.minimum(at, k - 1)))
        for step in (1, 2):  # a little further out on both sides, for a tighter interval
            best = np.minimum(best, np.minimum(self._keys(x, every, np.clip(at - 1 - step, 0, k - 1)), self._keys(x, every, np.minimum(at + step, k - 1))))
        reach = np.sqrt((best // k).astype(np.float64))
        room = 1e-9 * (own + reach + 1)
        low = np.searchsorted(self.norms, own - reach - room, "left")
        high = np.searchsorted(self.norms, own + reach + room, "right")
        ends = np.cumsum(high - low)
        first = 0
        while first < n:  # as many rows at once as PAIRS allows
            done = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, done + PAIRS, "right")), first + 1)
            size = (high - low)[first:last]
            row = np.repeat(np.arange(first, last), size)
            start = ends[first:last] - size - done
            entry = np.arange(len(row)) - np.repeat(start - low[first:last], size)
            best[first:last] = np.minimum(best[first:last], np.minimum.reduceat(self._keys(x, row, entry), start))
            first = last
        return best % k, best // k


@dataclass(frozen=True)
class Codebooks:
    """Entries [part, entry, component] of integers, and the largest integer that a component may be."""

    entries: np.ndarray
    limit: int

    @property
    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))

    @property
    def sha256(self) -> str:
        return sha256(self.text.encode()).hexdigest()


def _limit(width: int) -> int:
    """Components so large that sums of squared distances still fit 64 bits, with an index beside them."""
    return 1 << ((60 - 8 - max(width, 1).bit_length()) // 2 - 1)


def _integers(column: pa.Array, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their integers [component, row]); short vectors are filled up with zeros."""
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null elements come as nan
    row = np.repeat(np.arange(n), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    bad = np.bincount(row[~np.isfinite(values)], minlength=n) > 0
    kept = np.nonzero(column.is_valid().to_numpy(zero_copy_only=False) & ~bad)[0]
    new = np.full(n, -1)
    new[kept] = np.arange(len(kept))
    out = np.zeros((width, len(kept)), np.int64)
    own = ~bad[row] & (new[row] >= 0)
    out[place[own], new[row[own]]] = np.floor(np.clip(SCALE * values[own], -limit, limit)).astype(np.int64)
    return kept, out


def _kept(rows: DataFrame) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & finite)


def _rows(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(vector, vec_id) and, if a column is named, label."""
    kind = dict(df.dtypes)[vector_col]
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    return df.select(vector.alias("vector"), F.col(id_col).alias("vec_id"), *([F.col(label_col).alias("label")] if label_col else []))


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all vectors of ``df``, started with those of the least ids (null last, equal ids by vector).

    Components become floor(256 x). Rows whose vector is null, or holds null or
    non-finite components, are left out. Vectors of unlike lengths, or of one that
    isn't a multiple of ``parts``, are filled up with zeros; components of very
    large size are held at a limit that keeps distances within 64 bits (32,768 for
    64 components). A round sums parts up in the scan and shuffles a row for each
    task and entry; a table of fewer rows than entries has as many entries, an empty
    one none. ``df`` is read once for each round and twice before.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits, so 1 to 256 entries")
    rows = _rows(df, id_col, vector_col)
    longest = _kept(rows).agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    limit = _limit(width)
    first = _kept(rows).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = [_integers(c, width, limit)[1] for c in first.column(0).chunks] or [np.zeros((width, 0), np.int64)]
    start = np.concatenate(start, 1)
    books = Codebooks(start.reshape(parts, width // parts, start.shape[1]).transpose(0, 2, 1).copy(), limit)
    for _ in range(rounds if books.entries.size else 0):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry moved to the floor of its parts' mean; unused ones stay."""
    share = rows.sparkSession.sparkContext.broadcast(books)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = share.value
        parts, k, d = books.entries.shape
        annuli = [Annuli(e) for e in books.entries]
        sums, counts = np.zeros((parts, d, k), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            kept, x = _integers(batch.column(0), parts * d, books.limit)
            for p, columns in enumerate(x.reshape(parts, d, len(kept)) if len(kept) else ()):
                at = annuli[p].nearest(columns)[0]
                counts[p] += np.bincount(at, minlength=k)
                for c in range(d):  # exact: a batch's sums stay below 2 ** 53
                    sums[p, c] += np.bincount(at, weights=columns[c], minlength=k).astype(np.int64)
        p, at = np.nonzero(counts)
        slots = pa.array((p * k + at).astype(np.int32))
        yield pa.RecordBatch.from_arrays([slots, pa.array(counts[p, at]), pa.array(sums[p, :, at].tolist(), pa.list_(pa.int64()))], ["slot", "n", "sums"])

    found = rows.select("vector").mapInArrow(scan, "slot int, n long, sums array<long>").select("slot", "n", F.posexplode("sums").alias("c", "sum"))
    moved = books.entries.copy()
    k = moved.shape[1]
    for r in found.groupBy("slot", "c").agg(F.sum("n").alias("n"), F.sum("sum").alias("total")).collect():  # a row for each component of the codebooks
        moved[r.slot // k, r.slot % k, r.c] = r.total // r.n
    return Codebooks(moved, books.limit)


def encode(df: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """(vec_id, code string, error long) of all rows whose vector is whole, and ``label`` if a column is named.

    The code has two hexadecimal digits for each part, the index of its nearest
    entry, of equally near ones the lowest; the error is the sum of squared
    distances over the parts. Repeated and null ids are rows like any other.
    Vectors longer than those that the codebooks were trained on are an error.
    """
    rows = _rows(df, id_col, vector_col, label_col)
    share = df.sparkSession.sparkContext.broadcast(books)
    names = rows.columns[1:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = share.value
        parts, k, d = books.entries.shape
        annuli = [Annuli(e) for e in books.entries] if k else []
        for batch in batches:
            kept, x = _integers(batch.column(0), parts * d, books.limit) if k else ((), None)
            if not len(kept):
                continue
            code, error = np.zeros((len(kept), parts), np.uint8), np.zeros(len(kept), np.int64)
            for p, columns in enumerate(x.reshape(parts, d, len(kept))):
                at, distance = annuli[p].nearest(columns)
                code[:, p] = at
                error += distance
            digits = code.tobytes().hex()
            said = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(kept)) for c in batch.columns[1:]), pa.array(said, pa.string()), pa.array(error)], [*names, "code", "error"])

    kinds = dict(rows.dtypes)
    coded = rows.mapInArrow(scan, ", ".join(f"{c} {kinds[c]}" for c in names) + ", code string, error long")
    return coded.select("vec_id", "code", "error", *names[1:])


def decode(coded: DataFrame, books: Codebooks, out_col: str = "vector") -> DataFrame:
    """``coded`` with the vector that its ``code`` stands for, as ``out_col`` array of doubles; null codes have none."""
    share = coded.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def vectors(codes):
        entries = share.value.entries
        each = np.arange(entries.shape[0])
        return codes.map(lambda c: None if c is None else (entries[each, list(bytes.fromhex(c))].ravel() / SCALE).tolist())

    return coded.withColumn(out_col, vectors("code"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (…, error, label) with ``label_error``, the errors of equal labels summed, nulls together.

    Rows are summed before they are shuffled. Few labels are broadcast; of many,
    each sum goes to ``SALTS`` groups, over which the rows of a label are dealt.
    """
    kept = stash(coded, "codes")
    totals = stash(kept.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "__label")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return kept.join(F.broadcast(totals), same).drop("__label")
    dealt = kept.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    totals = totals.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(totals, same & (F.col("__salt") == F.col("__part"))).drop("__label", "__salt", "__part")
