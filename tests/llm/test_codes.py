"""Token ids, fill-in-middle texts and vector codes against plain versions, on tables and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from tidemark.llm import bpe, fim, queries, vectorcodes

SF = "/root/testdata/sf0.001"
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_multi_50k.tiktoken"), "rb"))}
TIKTOKEN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    (1, None), (2, ""), (3, " \t\r\n\x0b "), (4, "one"), (4, "one"), (None, "one"), (None, None), (5, "a\nb\n\nc"), (6, "\n"), (7, "\n\n\n"), (8, "no end\n"), (9, "<P>\n<"), (10, "x<S>y"), (11, "<M>"),
    (12, "a<\n<P\nS>\n<<\n"), (13, "漢字 \U0001f600\n\U0001f600 é ß\r\nİ K"), (14, "lorem ipsum\n" * 40_000), (15, "z" * 70_000), (16, "ab" * 900 + " " * 5_000 + "\n"), (17, "I'll they've 123 4567  don't\t\tx"), (18, "՘֋ \U00011de0 \x1c\x00"),
]


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def packed(text):
    ids = TIKTOKEN.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "x", "y", 1, "p") for i, t in ODD], "doc_id long, text string, ids string, form string, n int, prefix string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("where", ["odd", "table"])
def test_tokens(spark, odd, where):
    folder = odd if where == "odd" else SF
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(repr, queries.op11_bpe(spark, folder).collect()))
    assert got == sorted(repr(r) for r in spark.createDataFrame([(i, len(packed(t)) // 4, sha(packed(t)), sha(t)) for i, t in docs], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect())


def test_tokens_of_random_texts():
    draw = random.Random(5)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    encode = bpe.Vocabulary.read(bpe.VOCABULARY).encoder()
    some = ["".join(draw.choice(every) if draw.random() < 0.3 else draw.choice("ab  \n\t1'sé漢. \x1c") for _ in range(draw.randrange(60))) for _ in range(2_000)]
    some += ["".join(draw.choice("abcd") for _ in range(draw.randrange(400, 1_500))) for _ in range(40)]
    assert encode(some) == [packed(t) for t in some]


@pytest.mark.parametrize("row_bytes", [2, 7, 64, 4_096])
def test_merges_whatever_the_bound_of_rows(monkeypatch, row_bytes):
    monkeypatch.setattr(bpe, "ROW_BYTES", row_bytes)
    monkeypatch.setattr(bpe, "CELLS", 256)
    draw = random.Random(row_bytes)
    pieces = ["".join(draw.choice("aeinrst") for _ in range(draw.randrange(1, 60))).encode() for _ in range(300)]
    single = tiktoken.Encoding("single", pat_str=r"[\s\S]+", mergeable_ranks=RANKS, special_tokens={})
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in bpe.Vocabulary.read(bpe.VOCABULARY).merged(pieces)] == [single.encode_ordinary(p.decode()) for p in pieces]


def test_ranks_that_fall_while_merging():
    """A longer token may have a lower rank than its parts; order then tells."""
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"ab": 500, b"abc": 1, b"bc": 400, b"abab": 2, b"cab": 3}
    plain = tiktoken.Encoding("falling", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.Vocabulary(ranks, r"[\s\S]+")
    draw = random.Random(3)
    for _ in range(300):
        piece = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 30))).encode()
        want = plain.encode_ordinary(piece.decode())
        assert list(struct.unpack(f"<{len(want)}I", own.merged_rows([piece])[0])) == want
        assert list(struct.unpack(f"<{len(want)}I", own.merged_long(piece))) == want


def test_ids_outside_the_vocabulary(spark):
    null, bad = spark.createDataFrame([(None,)], "ids binary"), spark.createDataFrame([(bytearray(struct.pack("<I", 50_256)),)], "ids binary")
    assert bpe.decode(null).first().decoded == b""
    with pytest.raises(Exception, match="50256 is no id"):
        bpe.decode(bad).collect()


def plain_fim(i, text):
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return i, n, form, len(x), len(y), sha(f"<P>{x}<S>{z}<M>{y}" if form == "psm" else f"<S>{z}<P>{x}<M>{y}"), sha(text)


@pytest.mark.parametrize("where", ["odd", "table"])
def test_fill_in_middle(spark, odd, where):
    folder = odd if where == "odd" else SF
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, queries.op12_fill_in_middle(spark, folder).collect()))) == sorted(repr(plain_fim(i, t)) for i, t in docs)


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
def test_units_are_the_matches_of_their_grammar(spark, unit):
    draw = random.Random(unit)
    some = [t or "" for _, t in ODD if len(t or "") < 3_000] + ["".join(draw.choice("ab1_ \n\t.!?-é\U0001f600。") for _ in range(draw.randrange(40))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, text string").select("i", fim.units(F.col("text"), unit).alias("u")).collect()
    assert {r.i: r.u for r in got} == {i: re.findall(fim.UNITS[unit].grammar, t) for i, t in enumerate(some)}


@pytest.mark.parametrize(("unit", "rate", "spm"), [("word", 100, 100), ("character", 60, 0), ("run", 50, 50)])
def test_texts_come_back(spark, odd, unit, rate, spm):
    docs = spark.read.parquet(f"{odd}/documents.parquet").where("length(text) < 3000 or text is null")
    made = fim.transform(docs, unit=unit, rate=rate, spm_rate=spm, markers=("[pre]", "[suf]", "[mid]"))
    got = made.select("doc_id", fim.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("text")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r.doc_id, r.text or "")) for r in docs.collect())
    forms = {r.form for r in made.collect()}
    assert forms <= {"plain", "psm", "spm"} and ("psm" not in forms if spm == 100 else True)


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<a", "a>", "<M>"), ("", "<S>", "<M>")])
def test_markers_that_overlap_are_refused(spark, markers):
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([(1, "x")], "doc_id long, text string"), markers=markers)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = sorted(((i, v + [0] * (width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = width // parts
    cut = [[v[p * d : p * d + d] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for c in cut:
            for p in range(parts):
                groups[p, nearest(p, c[p])[1]].append(c[p])
        for (p, k), members in groups.items():
            books[p][k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)]


def vectors_of(kind):
    draw = np.random.default_rng(4)
    if kind == "odd":
        some = [(i, [float(x) for x in draw.normal(size=32)], i % 3 or None) for i in range(150)]
        some += [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, None), (203, [float("inf"), *[0.0] * 31], 2), (204, [1.0, None, *[0.0] * 30], 2)]
        return some + [(5, some[5][1], None), (5, [0.5] * 32, 7), (None, [0.25] * 32, None), (-3, [-0.001] * 32, 7), (7, [0.25] * 32, None)] + [(300 + i, [0.5] * 32, 8) for i in range(90)]
    if kind == "few":
        return [(3, [1.0] * 16, None), (1, [2.0] * 16, None), (2, [1.5] * 16, 1)]
    if kind == "lengths":
        return [(i, [float(i % 7), -1.5, *[0.25] * (i % 5)], i % 2) for i in range(80)]
    return [] if kind == "empty" else [(1, [], None), (2, [], 4), (3, None, None)]


@pytest.mark.parametrize("kind", ["odd", "few", "lengths", "empty", "hollow"])
@pytest.mark.parametrize("few_labels", [True, False])
def test_vector_codes(spark, tmp_path, monkeypatch, kind, few_labels):
    monkeypatch.setattr(vectorcodes, "PAIRS", 500)
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 100 if few_labels else 0)
    some = vectors_of(kind)
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in some], "vec_id long, embedding array<float>, label int, code string, error int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    some = [(r.vec_id, r.embedding, r.label) for r in table.collect()]  # as 32-bit values
    assert sorted(map(repr, map(tuple, queries.op13_vector_codes(spark, str(tmp_path)).collect()))) == sorted(map(repr, plain_codes(some)))


@pytest.mark.parametrize("spread", [1, 3, 1_000, 10**6])
def test_nearest_entries_are_exact(spread):
    draw = np.random.default_rng(spread)
    entries, x = draw.integers(-spread, spread + 1, (64, 4)), draw.integers(-2 * spread, 2 * spread + 1, (3_000, 4))
    entries[40] = entries[3]  # of equal entries the lower index
    at, distance = vectorcodes.Annuli(entries).nearest(np.ascontiguousarray(x.T))
    every = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (at == every.argmin(1)).all()


def test_huge_components_are_held(spark):
    table = spark.createDataFrame([(1, [1e30] * 16), (2, [-1e30] * 16), (3, [0.0] * 16)], "vec_id long, embedding array<double>")
    books = vectorcodes.train(table)
    assert [r.error for r in vectorcodes.encode(table, books).collect()] == [0, 0, 0] and abs(books.entries).max() == books.limit


def test_codes_decode_to_entries(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = vectorcodes.train(table)
    got = vectorcodes.decode(vectorcodes.encode(table, books), books).join(table.select("vec_id", "embedding"), "vec_id").collect()
    for r in got[:50]:
        whole = np.floor(256 * np.array(r.embedding))
        assert int(((whole - 256 * np.array(r.vector)) ** 2).sum()) == r.error
    assert len(got) == table.count()
