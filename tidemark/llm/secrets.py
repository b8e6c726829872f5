"""Secret scan: fixed patterns, and random strings by their token efficiency."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, merged, texts

KINDS = ("assign", "access", "hex", "random")
#: Characters a token below which a string counts as random: if it mixes digits, small and capital letters, and if it doesn't.
RATIO, PLAIN_RATIO = 2.3, 2.01
#: Characters that a string needs for the ratio to tell, if it mixes classes and if it doesn't: from there on nine of ten
#: random strings of each class are found, and hardly a word is (figures in README).
LEAST, PLAIN_LEAST = 12, 17
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rf"({'|'.join(map(_either, WORDS[:4]))}|{_either('api')}_?{_either('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # from the left, the same runs as [0-9a-f]+ of 16 or more

_mark = lambda chars: bytes(120 if chr(c) in chars else 32 for c in range(256))
HEX_MARK = _mark("0123456789abcdef")
LONG_MARK = _mark("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
LONG = re.compile(rb"x{%d,}" % LEAST)
PART = re.compile(r"[^+/_-]+")
#: Known digests and identifiers, which are random but no secrets: hex digests of usual lengths, UUIDs, integrity values.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha(?:1|256|384|512)-[a-z0-9+/=]+)", re.IGNORECASE | re.ASCII)


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, by start and kind."""
    lower = raw.lower()
    assign = (b":" in raw or b"=" in raw) and any(w.encode() in lower for w in WORDS)
    access = b"AKIA" in raw
    runs = b"x" * 16 in raw.translate(HEX_MARK)
    if not (assign or access or runs):
        return []
    text, found = raw.decode(), []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if access:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if runs:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def mixes(part: str) -> bool:
    """Does it mix digits, small and capital letters other than by a capital first letter?"""
    kinds = any(c.isdigit() for c in part) + (part.lower() != part) + (part.upper() != part)
    return kinds > 1 and not part[1:].islower()


def random_parts(word: str, tokens, ratio: float, plain_ratio: float) -> Iterator[tuple[int, int]]:
    """Spans in a run of letters, digits and separators that have few characters a token.

    A run that mostly consists of mixed parts is judged whole; otherwise, or if it
    passes, each of its parts between separators is. Digits alone are an identifier.
    """
    parts = [m.span() for m in PART.finditer(word)]
    mixed = sum(b - a for a, b in parts if mixes(word[a:b]))
    if len(word) < LEAST or KNOWN.fullmatch(word):
        return
    if 2 * mixed >= len(word) and len(word) < ratio * len(tokens(word)):
        yield 0, len(word)
        return
    for a, b in parts:
        part = word[a:b]
        if b - a >= (LEAST if mixes(part) or (any(map(str.isdigit, part)) and not part.isdigit()) else PLAIN_LEAST) and not part.isdigit() and not KNOWN.fullmatch(part) and b - a < (ratio if mixes(part) else plain_ratio) * len(tokens(part)):
            yield a, b


def random_spans(raw: bytes, base: list[tuple[int, int, int]], tokens, ratio: float, plain_ratio: float = PLAIN_RATIO) -> list[tuple[int, int, int]]:
    """Strings of ``LEAST`` characters or more (``PLAIN_LEAST`` if of one class) with few characters a token.

    What ``base`` covers is cut out of them; known digests and identifiers don't count.
    """
    marked = raw.translate(LONG_MARK)
    if b"x" * LEAST not in marked:
        return []
    out, done, chars, i, covered = [], 0, 0, 0, merged([a for a, _, _ in base], [b for _, _, b in base])
    for m in LONG.finditer(marked):
        chars += len(raw[done : m.start()].decode())
        done, start = m.start(), chars
        word = raw[m.start() : m.end()].decode()
        while i < len(covered) and covered[i][1] <= start:
            i += 1
        free, at, j = [], start, i
        while j < len(covered) and covered[j][0] < start + len(word):
            free.append((at, covered[j][0]))
            at, j = covered[j][1], j + 1
        for a, b in [*free, (at, start + len(word))]:
            if b > a:
                out += [(a + x, 3, a + y) for x, y in random_parts(word[a - start : b - start], tokens, ratio, plain_ratio)]
    return out


def vocabulary(spark: SparkSession, path: str):
    """Token ranks, read on the driver and broadcast: a public vocabulary of some 50,000 entries."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind. Null texts count as empty and have none. Of kind "random" are strings
    that a public vocabulary cuts into tokens of few characters, ``LEAST``
    characters at least, or ``PLAIN_LEAST`` where they don't mix digits, small and
    capital letters; digits alone, known digests and UUIDs are left out.
    """
    ranks = vocabulary(docs.sparkSession, vocabulary_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        tokens = tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        for batch in chunks(batches, "text"):
            counts, digest, spans = ([], [], [], []), [], []
            for raw in texts(batch.column(1)):
                base = base_spans(raw)
                more = random_spans(raw, base, tokens, ratio)
                for kind, n in enumerate(counts):
                    n.append(sum(k == kind for _, k, _ in base + more))
                digest.append(sha256(said(base).encode()).hexdigest())
                spans.append(said(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return rows.mapInArrow(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", ratio: float = RATIO, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; all columns stay, null texts too."""
    ranks = vocabulary(docs.sparkSession, vocabulary_path)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        tokens = tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={}).encode_ordinary
        for batch in chunks(batches, text_col):
            old = batch.column(at).to_pylist()
            for i, raw in enumerate(texts(batch.column(at))):
                base = base_spans(raw)
                done, parts, text = 0, [], old[i]
                for a, k, b in sorted(base + random_spans(raw, base, tokens, ratio)):
                    if b > done:
                        parts += [text[done:a], f"[{KINDS[k]}]" if a >= done else ""]
                        done = b
                if parts:
                    old[i] = "".join([*parts, text[done:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(old, batch.column(at).type))

    return docs.mapInArrow(scan, docs.schema)
