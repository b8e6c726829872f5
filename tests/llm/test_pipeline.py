"""The corpus pipeline against its operators and against a plain version of every stage in a row."""

from __future__ import annotations

import re

import duckdb
import pytest
from test_disclosure import brute as disclosing
from test_disclosure import plain_words
from test_nearcopies import brute as leaders

import corpus_pipeline
from tidemark.llm import pii, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Short documents of the small table, with more copies, values and passages planted."""
    root = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500")
    rows = [tuple(r) for r in docs.collect()]
    item = " ".join(f"q{i}" for i in range(30))
    extra = [f"report {i} zorblat {' '.join(f'u{i}x{k}' for k in range(20))} zo@mail.example" for i in range(5)] + [f"w{i} " * 20 + item + f" e{i}" for i in range(3)] + [item, rows[0][1], rows[1][1], "", "about zorblat and rain"]
    rows += [(100_000 + i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(extra)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("cast(item_id as string) as item_id", "text").union(spark.createDataFrame([("own", item)], "item_id string, text string")).write.parquet(f"{root}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    return root


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def cleared(text, grams):
    """A text without the words that windows of ``grams`` (length to set) cover; None if most are covered."""
    where = [m.span() for m in re.finditer(WORD, text)]
    words = [lower(text[a:b]) for a, b in where]
    hit = {k for n, some in grams.items() for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in some for k in range(i, i + n)}
    if hit and 2 * len(hit) > len(words):
        return None
    out, done = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[done : where[k][0]])
        done = where[k][1]
    return "".join([*out, text[done:]])


def masked(texts):
    """Texts without values and with disclosing terms generalised or gone."""
    action, wider = disclosing(texts)
    out = []
    for text in texts:
        spans = [(a, b, "" if action(text, w) == "remove" else wider[w]) for w, a, b, inside in plain_words(text) if not inside and action(text, w)]
        spans += [(a, b, f"[{pii.KINDS[k].upper()}]") for k, a, b in pii.base_spans(text.encode())[1]]
        parts, done = [], 0
        for a, b, what in sorted(spans):
            if b > done:
                parts += [text[done:a], what if a >= done else ""]
                done = b
        out.append("".join([*parts, text[done:]]))
    return out


def test_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    score = {r.doc_id: r.score for r in toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).score(docs).collect()}
    rows = {r.doc_id: tuple(r) for r in docs.collect() if score[r.doc_id] < 0.5}
    rows = {i: rows[i] for i in leaders([(i, r[1]) for i, r in rows.items()])}
    grams = {}
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = [lower(x) for x in re.findall(WORD, r.text or "")]
        n = min(10, len(w))
        grams.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    grams.pop(0, None)
    left = {i: (r, cleared(r[1], grams)) for i, r in rows.items()}
    rows = {i: (r[0], t, *r[2:]) for i, (r, t) in left.items() if t is not None}
    assert len(rows) < len(left) and any(t not in (None, r[1]) for r, t in left.values())
    new = masked([r[1] for r in rows.values()])
    assert any("zorblat" in r[1] for r in rows.values()) and not any("zorblat" in t for t in new)
    rows = {i: (r[0], t, *r[2:]) for (i, r), t in zip(rows.items(), new, strict=True)}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [list(r) for r in rows.values()])
    copies = {i: n for i, n in duck.sql(f"SELECT doc_id, copies FROM ({queries.ORACLES['op8_mixture']})").fetchall()}
    assert got == sorted(r for i, r in rows.items() for _ in range(copies[i]))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "mixture"]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id: r for r in docs.collect()}
        assert now.keys() <= kept.keys() and all(r.lang == kept[i].lang and r.source == kept[i].source for i, r in now.items())
        if name in ("toxicity", "near_dedup"):
            assert all(r.text == kept[i].text for i, r in now.items())
        if name == "pii":
            assert now.keys() == kept.keys()
        kept = now


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
