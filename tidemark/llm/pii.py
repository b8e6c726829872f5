"""Personal data: fixed patterns, and terms that disclose them by corpus co-occurrence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, WordHashes, bitmap, chunks, discard, in_bitmap, merged, stash, texts, unused

KINDS = ("email", "ip", "card", "phone")
#: A wider form of values (see ``forms``) in more than this share of the texts identifies nobody.
WIDEST = 0.01
#: Letters and digits that a word of an address needs to be looked for as a name.
NAME = 4
#: Share of a value's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.5, 0.8
#: Share of a term's texts that have the value, beyond which the term goes from all other texts as well.
EVERYWHERE = 0.5
#: A term is wider than another if it stands in this share of the other's texts, and in this many times as many in all.
WIDER_SHARE, WIDER_TIMES = 0.8, 2
#: Texts in which a term must be generalised for a wider one to be told: in fewer, most words of a text stand in all of them.
WIDER_TEXTS = 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
NO_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)


def emails(text: str) -> list[tuple[int, int]]:
    """Driven by the at signs, so that a long run of letters costs no more than its length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
        last = m.end() if m else last
        at = text.find("@", m.end() if m else at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in NUMBERS.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(raw: bytes) -> tuple[str | None, list[tuple[int, int, int]]]:
    """(text if anything was looked for, (kind, start, end) in code points by kind and start)."""
    digits = len(raw.translate(None, NO_DIGIT))
    at, ip, card, phone = b"@" in raw, digits >= 4 and raw.count(b".") >= 3, digits >= 16, digits >= 8 and b"+" in raw
    if not (at or ip or card or phone):
        return None, []
    text = raw.decode()
    found = (emails(text) if at else [], addresses(text) if ip else [], cards(text) if card else [], phones(text) if phone else [])
    return text, [(k, a, b) for k, spans in enumerate(found) for a, b in spans]


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[bytes, int, int]]:
    """Words (term, start, end) of a text that no span covers, even in part."""
    covered, i = merged([a for _, a, _ in spans], [b for _, _, b in spans]), 0
    for m in WORD.finditer(text):
        s, e = m.span()
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if i == len(covered) or covered[i][0] >= e:
            yield m[0].encode().translate(WORD_TABLE), s, e


def forms(kind: int, value: str) -> list[str]:
    """A value and its wider form: an address's domain, a network's first half, a card's issuer, a phone's area."""
    digits = "".join(c for c in value if c.isdigit())
    wide = {"email": value.rpartition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[KINDS[kind]]
    return [f"{kind}:{value}", f"{kind}*{wide}"]


def name_words(kind: int, value: str) -> set[bytes]:
    """Words of an address before its at sign that may be a name."""
    if KINDS[kind] != "email":
        return set()
    words = value.rpartition("@")[0].encode().translate(WORD_TABLE).split()
    return {w for w in words if len(w) >= NAME and not w.isdigit()}


SCANNED = "doc_id {}, th long, th2 long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, entities array<long>, wide array<boolean>, named array<long>, names array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in each text: values and forms (entities), and words of the text that are names in a value (names, with the value)."""
    from xxhash import xxh64_intdigest

    key = lambda s: xxh64_intdigest(s.encode(), 42) - (1 << 63)
    hashes = WordHashes()
    for batch in chunks(batches, "text"):
        counts, digest, base, entities, wide, named, names = ([], [], [], []), [], [], [], [], [], []
        for raw in texts(batch.column(1)):
            text, spans = base_spans(raw)
            for kind, n in enumerate(counts):
                n.append(sum(k == kind for k, _, _ in spans))
            base.append(said(spans))
            digest.append(sha256(base[-1].encode()).hexdigest())
            values = {(k, text[a:b].lower()) for k, a, b in spans}
            found = {key(form): i > 0 for v in values for i, form in enumerate(forms(*v))}
            entities.append(list(found))
            wide.append(list(found.values()))
            sought = {(w, key(forms(*v)[0])) for v in values for w in name_words(*v)}
            free = {w for w, _, _ in words_outside(text, spans)} if sought else set()
            pairs = sorted((hashes[w], e) for w, e in sought if w in free)
            named.append([e for _, e in pairs])
            names.append(np.array([h for h, _ in pairs], np.uint64).view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), *(pa.array(n, pa.int64()) for n in counts), pa.array(digest, pa.string()), pa.array(base, pa.string()), pa.array(entities, longs), pa.array(wide, pa.list_(pa.bool_())), pa.array(named, longs), pa.array(names, longs)],
            ["doc_id", "th", "th2", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "wide", "named", "names"],
        )


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(th, text) of the texts named by ``wanted`` (th), one row each (where two texts share a hash, one of them)."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, "th", 24))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            th = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.unique(th, return_index=True)[1]
            yield batch.take(pa.array(first[in_bitmap(bits.value, th[first].view(np.uint64))]))

    found = rows.select("th", "text").mapInArrow(scan, "th long, text string")
    return found.join(wanted.select("th"), "th", "left_semi").dropDuplicates(["th"])


#: (word, count) pairs that a task sums up before it hands them on.
HELD_COUNTS = 500_000


def _summed(found: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(np.concatenate(found), return_inverse=True)
    n = np.zeros(len(h), np.int64)
    np.add.at(n, at, np.concatenate(times))
    return h, n


def _document_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(h long, df long): in how many distinct texts the terms stand, by hash; a few other words may come along.

    All rows are counted, and of each text that repeats the copies are taken off again,
    so that only such texts are shuffled.
    """
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(terms, "h", 24))
    repeated = stash(rows.groupBy("th").agg((1 - F.count("*")).alias("weight")).where("weight < 0"), "repeated")
    weighed = rows.select("text", F.lit(1).cast("long").alias("weight"))
    if not repeated.isEmpty():
        weighed = weighed.union(_texts(rows, repeated).join(repeated, "th").select("text", "weight"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found, times, size = WordHashes(), [], [], 0
        for batch in chunks(batches, "text"):
            for raw, weight in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                h = hashes.of(raw.translate(WORD_TABLE).split())
                found.append(np.unique(h[in_bitmap(bits.value, h)]))
                times.append(np.full(len(found[-1]), weight, np.int64))
                size += len(found[-1])
            if size > HELD_COUNTS:  # summed over as much of a task as has room
                h, n = _summed(found, times)
                if len(h) > HELD_COUNTS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "df"])
                    h, n = h[:0], n[:0]
                found, times, size = [h], [n], len(h)
        if found:
            h, n = _summed(found, times)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "df"])

    return weighed.mapInArrow(scan, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def _named(batch: pa.RecordBatch, bits: np.ndarray | None) -> Iterator[tuple[int, int, bytes]]:
    """(th, th2, text) of the texts of a batch (th, th2, text) that a bitmap names (None: all), once each."""
    th, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    at = np.unique(np.stack([th, second]), axis=1, return_index=True)[1]
    if bits is not None:
        at = at[in_bitmap(bits, th[at].view(np.uint64))]
    yield from zip(th[at].tolist(), second[at].tolist(), texts(batch.column(2).take(pa.array(at))), strict=True)


def _vocabulary(rows: DataFrame, holders: np.ndarray) -> DataFrame:
    """(h long): the words of the texts named by a bitmap, some more than once."""
    bits = rows.sparkSession.sparkContext.broadcast(holders)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            found = [np.unique(hashes.of(raw.translate(WORD_TABLE).split())) for _, _, raw in _named(batch, bits.value)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], ["h"])

    return rows.select("th", "th2", "text").mapInArrow(scan, "h long")


def _places(rows: DataFrame, holders: np.ndarray, terms: np.ndarray, every: bool, anywhere: np.ndarray | None = None) -> DataFrame:
    """(th, th2, h, start, end) of terms outside protected values, the first place in each text or every one.

    Bitmaps name texts and the terms looked for in them; terms of ``anywhere`` are
    looked for in all other texts as well.
    """
    share = rows.sparkSession.sparkContext.broadcast((holders, terms, anywhere))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, terms, anywhere = share.value
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            for th, second, raw in _named(batch, holders if anywhere is None else None):
                wanted = terms
                if anywhere is not None and not in_bitmap(holders, np.array([th], np.int64).view(np.uint64))[0]:
                    wanted = anywhere
                    if not in_bitmap(wanted, hashes.of(raw.translate(WORD_TABLE).split())).any():
                        continue
                text, spans = base_spans(raw)
                words = list(words_outside(text or raw.decode(), spans))
                h = hashes.of([w for w, _, _ in words])
                at = np.nonzero(in_bitmap(wanted, h))[0] if len(h) else np.zeros(0, np.int64)
                if not every:
                    at = at[np.unique(h[at], return_index=True)[1]]
                ends = np.array([(words[i][1], words[i][2]) for i in at], np.int32).reshape(-1, 2)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), th, np.int64)), pa.array(np.full(len(at), second, np.int64)), pa.array(h[at].view(np.int64)), pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["th", "th2", "h", "start", "end"])

    return rows.select("th", "th2", "text").mapInArrow(scan, "th long, th2 long, h long, start int, end int").distinct()


def disclosing_terms(scanned: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(th, h, action): terms, by hash, that give away too much of a value in the text th; None if no term could.

    Rows with a null th hold for all texts: of a term of whose texts more than ``EVERYWHERE``
    have the value, which so is likelier than not wherever the term stands.

    Protected are values and their wider forms up to ``WIDEST``. With N distinct
    texts, a value c in n(c) of them, a term t in df(t) and both in co(c, t), the
    term reveals PMI(c, t) = log2((co(c, t) / n(c)) / (df(t) / N)) of the
    IC(c) = log2(N / n(c)) bits that the value is worth, wherever in a text it
    stands. Few texts say little: the share counts by co / (co + 1) and
    m / (m + 1), m the lesser of n and df, as is usual for such estimates; a term
    that stood with a value once so has a quarter of its share, and none of once
    can reach ``GENERALISE``. A word of the text that is a name in a value's address
    needs no such discount: that it belongs to the value shows from the address,
    and it reveals log2(N / df(t)) of the bits.

    As co is at most n(c), no term beyond df = N (n(c) / N) ** GENERALISE can reach
    that share; such terms are left out before pairs are counted.
    """
    n = float(scanned.select("th").distinct().count())
    every = scanned.select("th", F.explode(F.arrays_zip("entities", "wide")).alias("e")).select("th", F.col("e.entities").alias("entity"), F.col("e.wide").alias("wide")).distinct()
    own = every.groupBy("entity").agg(F.count("*").alias("nc"), F.max("wide").alias("wide"))
    own = stash(own.where((~F.col("wide")) | (F.col("nc") <= WIDEST * n)).select("entity", "nc"), "values")
    names = scanned.select("th", F.explode(F.arrays_zip("named", "names")).alias("e")).select("th", F.col("e.named").alias("entity"), F.col("e.names").alias("h")).distinct()
    names = stash(names.join(own, "entity"), "names")
    shared = own.where("nc > 1")
    most = max(own.join(names.select("entity"), "entity", "left_semi").unionByName(shared).agg(F.max("nc")).first()[0] or 0, 0)
    if not most:
        return None
    held = stash(every.select("th", "entity").join(shared, "entity"), "held")
    holders = bitmap(held, "th", 24)
    counts = _document_counts(rows, _vocabulary(rows, holders).union(names.select("h")))
    counts = stash(counts.where(F.col("df") <= n * (most / n) ** GENERALISE + 1), "terms")
    words = _places(rows, holders, bitmap(counts.where("df > 1"), "h", 24), every=False).select("th", "h").distinct()
    together = words.join(held.select("th", "entity"), "th").groupBy("entity", "h").agg(F.count("*").alias("co")).where("co > 1")
    ic = F.log2(F.lit(n) / F.col("nc"))
    least = F.least("nc", "df")
    share = F.log2(F.col("co") / F.col("nc") * n / F.col("df")) / ic * (F.col("co") / (F.col("co") + 1)) * (least / (least + 1))
    scored = together.join(own, "entity").join(counts, "h").withColumn("share", F.when(ic > 0, share))
    by_name = names.groupBy("entity", "h", "nc").agg(F.count("*").alias("co")).join(counts, "h").withColumn("share", F.when(ic > 0, F.log2(F.lit(n) / F.col("df")) / ic))
    both = scored.select("entity", "h", "co", "df", "share").unionByName(by_name.select("entity", "h", "co", "df", "share")).where(F.col("share") >= GENERALISE)
    scored = stash(both.select("entity", "h", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"), (F.col("co") > EVERYWHERE * F.col("df")).alias("all")), "scored")
    own = scored.join(every.select("th", "entity"), "entity").groupBy("th", "h").agg(F.max("action").alias("action"))
    everywhere = scored.where("all").groupBy("h").agg(F.max("action").alias("action")).select(F.lit(None).cast("long").alias("th"), "h", "action")
    flagged = stash(own.unionByName(everywhere), "flagged")
    discard(names, held, counts, scored)
    return None if flagged.isEmpty() else flagged


#: Pairs of terms that a task holds before it hands on how often each came.
HELD_PAIRS = 2_000_000


def _counted(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs and how often each came."""
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    at = np.concatenate([[0], np.nonzero((left[1:] != left[:-1]) | (right[1:] != right[:-1]))[0] + 1])
    n = np.diff(np.append(at, len(left)))
    return pa.RecordBatch.from_arrays([pa.array(left[at].view(np.int64)), pa.array(right[at].view(np.int64)), pa.array(n.astype(np.int64))], ["h", "x", "co"])


def wider_terms(rows: DataFrame, places: DataFrame, flagged: DataFrame) -> DataFrame:
    """(h, wider): for terms to be generalised the next wider term, where the corpus has one.

    A wider term subsumes the other: it stands in most of its texts and in many
    more, and discloses nothing itself. Of several the one in fewest texts is
    nearest. Words inside protected values are none, and a term that is generalised
    in fewer than ``WIDER_TEXTS`` texts has none.
    """
    spark = rows.sparkSession
    held = stash(places.where("action = 'generalise'").select("th", "h").distinct(), "generalised")
    own = stash(held.groupBy("h").agg(F.count("*").alias("n")).where(f"n >= {WIDER_TEXTS}"), "told")
    held = held.join(own, "h", "left_semi")
    some = stash(_texts(rows, held.select("th").distinct()), "holders")
    bits = spark.sparkContext.broadcast(bitmap(own, "h", 24))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        left, right, size = [], [], 0
        for batch in chunks(batches, "text", 1 << 20):
            for raw in texts(batch.column(1)):
                text, spans = base_spans(raw)
                h = np.unique(hashes.of([w for w, _, _ in words_outside(text or raw.decode(), spans)]))
                for g in h[in_bitmap(bits.value, h)] if len(h) else ():
                    left.append(np.full(len(h), g))
                    right.append(h)
                    size += len(h)
                    if size > HELD_PAIRS:  # one text may have more
                        yield _counted(left, right)
                        left, right, size = [], [], 0
        if left:
            yield _counted(left, right)

    both = some.mapInArrow(pairs, "h long, x long, co long").groupBy("h", "x").agg(F.sum("co").alias("co")).join(own, "h")
    both = both.where((F.col("h") != F.col("x")) & (F.col("co") >= WIDER_SHARE * F.col("n"))).join(flagged.select(F.col("h").alias("x")), "x", "left_anti")
    both = stash(both, "wider")
    known = spark.sparkContext.broadcast(bitmap(both, "x", 24))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            found = {w for raw in texts(batch.column(1)) for w in raw.translate(WORD_TABLE).split()}
            words = list(found)
            h = hashes.of(words)
            at = np.nonzero(in_bitmap(known.value, h))[0]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array([words[i].decode() for i in at], pa.string())], ["x", "word"])

    names = some.mapInArrow(named, "x long, word string").groupBy("x").agg(F.min("word").alias("word"))
    df = _document_counts(rows, both.select(F.col("x").alias("h"))).withColumnRenamed("h", "x")
    fit = both.join(df, "x").where(F.col("df") >= WIDER_TIMES * F.col("n")).join(names, "x")
    return fit.groupBy("h").agg(F.min(F.struct("df", "word")).alias("w")).select("h", F.col("w.word").alias("wider"))


#: What names a text: two hashes, as of many texts two may share one.
TEXT_KEY = ("th", "th2")


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _found(docs: DataFrame, id_col: str, text_col: str, with_wider: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows read, what the scan found, and the disclosing spans (start, end, new text) of each (doc_id, th, th2)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns(dict(zip(TEXT_KEY, _hashes(F.col("text")), strict=True)))
    scanned = stash(rows.mapInArrow(_scan, SCANNED.format(dict(rows.dtypes)["doc_id"])), "pii")
    terms = disclosing_terms(scanned, rows)
    if terms is None:
        return rows, scanned, None
    own, everywhere = terms.where("th is not null"), terms.where("th is null").select("h", F.col("action").alias("other"))
    found = _places(rows, bitmap(own, "th", 24), bitmap(terms, "h", 24), True, bitmap(everywhere, "h", 24))
    found = found.join(own, ["th", "h"], "left").join(everywhere, "h", "left").where("action is not null or other is not null")
    places = stash(found.select(*TEXT_KEY, "h", "start", "end", F.greatest("action", "other").alias("action")), "places")
    if with_wider and not terms.where("action = 'generalise'").isEmpty():
        places = places.join(stash(wider_terms(rows, places, terms.select("h").distinct()), "named"), "h", "left")
    else:
        places = places.withColumn("wider", F.lit(None).cast("string"))
    new = F.when(F.col("action") == "remove", "").otherwise(F.coalesce("wider", F.lit("[TERM]")))
    spans = places.groupBy(*TEXT_KEY).agg(F.array_sort(F.collect_set(F.struct("start", "end", new.alias("new")))).alias("terms"))
    spans = scanned.select("doc_id", *TEXT_KEY).distinct().join(spans, [*TEXT_KEY]).select("doc_id", *TEXT_KEY, "terms")
    own = unused(docs, "id", *TEXT_KEY, "terms")
    return rows, scanned, stash(spans.toDF(*own), "spans")


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by kind and start;
    disclosing terms are of kind "term", in texts that have the value and, if it is
    likelier than not where the term stands, in all others. Null texts count as empty and have none. Ids may be
    of any type.
    """
    _, scanned, spans = _found(docs, id_col, text_col, False)
    if spans is None:
        return scanned.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.lit(0).cast("long").alias("n_term"), "base_sha256", F.col("base").alias("spans"))
    spans = spans.toDF("__id", "__th", "__th2", "terms")
    joined = scanned.join(spans, scanned["doc_id"].eqNullSafe(spans["__id"]) & (scanned["th"] == spans["__th"]) & (scanned["th2"] == spans["__th2"]), "left")
    flat = F.array_distinct(F.transform(F.coalesce("terms", F.expr("cast(array() as array<struct<start: int, end: int, new: string>>)")), lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string"))))
    every = F.array_join(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), flat), ",")
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.size(flat).cast("long").alias("n_term"), "base_sha256", every.alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with protected values replaced by their kind in brackets, and disclosing terms by a wider term or nothing.

    A term to be generalised gives way to the nearest wider one of the corpus
    ([TERM] if it has none), one to be removed to nothing (where, see scan_pii). All
    columns stay; rows without a value or such a term, null texts among them, are
    returned as they are. Of overlapping spans the first replaces, and what the
    others cover goes as well.
    """
    names = docs.columns
    at = names.index(text_col)
    _, _, spans = _found(docs, id_col, text_col, True)
    joined = docs
    if spans is not None:
        key, first, second, terms = spans.columns
        th, th2 = _hashes(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        joined = docs.join(spans, docs[id_col].eqNullSafe(spans[key]) & (th == spans[first]) & (th2 == spans[second]), "left").select(*[docs[c] for c in names], terms)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            old, changed = None, False
            terms = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * batch.num_rows
            for i, raw in enumerate(texts(batch.column(at))):
                text, base = base_spans(raw)
                if not base and not terms[i]:
                    continue
                if not changed:
                    old, changed = batch.column(at).to_pylist(), True
                text = text if text is not None else raw.decode()
                spans = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base] + [(t["start"], t["end"], t["new"]) for t in terms[i] or ()]
                done, parts = 0, []
                for a, b, what in sorted(spans):
                    if b > done:
                        parts += [text[done:a], what if a >= done else ""]
                        done = b
                old[i] = "".join([*parts, text[done:]])
            columns = [batch.column(j) if j != at or not changed else pa.array(old, batch.column(at).type) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(scan, docs.schema)
