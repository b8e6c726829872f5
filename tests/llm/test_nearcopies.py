"""The near-copy stage against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import nearcopies, simhash

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(pairs):
    """The least doc_id of each component, by comparing all distinct sets that share a shingle."""
    sets = sorted({shingles(t) for _, t in pairs}, key=sorted)
    root, where = list(range(len(sets))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where.get(g, ())}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
        for g in s:
            where.setdefault(g, []).append(i)
    at, least = {s: i for i, s in enumerate(sets)}, {}
    for doc, t in pairs:
        r = find(at[shingles(t)])
        least[r] = min(doc, least.get(r, doc))
    return sorted(least.values())


def edited(words, r, n):
    out = list(words)
    for at in r.choice(len(out), n, replace=False):
        out[at] = f"x{r.integers(1 << 30)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with one or two words of 100 changed (0.90 to 0.81), or eight (below 0.8), some of them around one text."""
    r = np.random.default_rng(3)
    texts = []
    for k in range(60):
        base = [f"w{k}-{i}" for i in range(100)]
        texts += [" ".join(base), " ".join(base).upper(), edited(base, r, 1), edited(base, r, 2), edited(base, r, 8)]
    centre = [f"c{i}" for i in range(100)]
    texts += [edited(centre, r, 1 + k % 3) for k in range(120)]
    texts += ["", " ", "one", "one two"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_stage_drops_near_copies(spark, planted):
    out = corpus_pipeline.distinct(spark, planted, SF)
    assert out.columns == planted.columns
    assert sorted(r.doc_id for r in out.collect()) == brute([tuple(r) for r in planted.collect()])


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = nearcopies.drop_near_copies(docs)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "c d")], "doc_id long, text string")
    assert nearcopies.drop_near_copies(docs.limit(0)).isEmpty()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in nearcopies.drop_near_copies(docs).collect()) == [(False, 1), (False, 3), (True, 0)]


def test_rows_without_ids(spark):
    """One row of each group stays, whatever its ids; what shares an id but no text is told apart."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (1, "other words than these are"), (None, "Other words than these are"), (5, "x y z"), (5, "p q r"), (5, "x y z"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([("None", text), ("1", "other words than these are"), ("5", "x y z"), ("5", "p q r"), ("None", "")])
    for drop in (nearcopies.drop_near_copies, simhash.drop_near_duplicates):
        assert sorted((str(r.doc_id), r.text or "") for r in drop(docs).collect()) == want


def test_unlike_texts_in_one_band(spark, monkeypatch):
    """Three thousand pages of one template, none near another, and a few near copies among them: few pairs are compared, and none is lost."""
    r = np.random.default_rng(8)
    common = [f"t{i}" for i in range(70)]
    texts = [" ".join(common + [f"p{k}-{i}" for i in range(26)]) for k in range(3_000)]
    texts += [" ".join(common + [f"p{k}-{i}" for i in range(26)][:-1] + [f"q{r.integers(1 << 30)}"]) for k in range(0, 3_000, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared = []
    monkeypatch.setattr(nearcopies, "_close", lambda pairs, sets, f=nearcopies._close: compared.append(pairs.count()) or f(pairs, sets))
    assert sorted(x.doc_id for x in nearcopies.drop_near_copies(docs).collect()) == list(range(3_000))
    assert len(compared) == nearcopies.ROUNDS + 2 and sum(compared) < 300_000 and compared[-1] < 3_000


def test_rounds_link_what_is_new(spark, planted, monkeypatch):
    """Each round joins components by new links alone; none is gone through twice, and none is lost."""
    given = []
    monkeypatch.setattr(nearcopies, "PAIR_LIMIT", 1)
    monkeypatch.setattr(nearcopies, "connected_components", lambda edges, f=nearcopies.connected_components: given.append({tuple(sorted(e)) for e in edges.collect()}) or f(edges))
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(planted).collect()) == brute([tuple(r) for r in planted.collect()])
    assert len(given) > 1 and given[1] and len(set().union(*given)) == sum(map(len, given))


def test_prefixes_lose_nothing(spark, monkeypatch):
    """Sets around 0.8 that all share a band, by prefixes alone, against all pairs."""
    r = np.random.default_rng(5)
    monkeypatch.setattr(nearcopies, "PAIR_LIMIT", 1)
    monkeypatch.setattr(nearcopies, "ROUNDS", 0)
    centre = [f"c{i}" for i in range(100)]
    texts = [edited(centre, r, int(k)) for k in r.integers(0, 6, 150)] + [" ".join(centre[: int(n)]) for n in r.integers(70, 100, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, nodes = [shingles(t) for t in texts], None
    rows = docs.selectExpr("doc_id", "text", "0L as th")
    nodes = nearcopies._sketches(rows).selectExpr("node", "n", "node as root").distinct()
    named = {x.node: x.doc_id for x in nearcopies._sketches(rows).collect()}
    table = nearcopies.stash(nearcopies._sets(rows, nodes), "sets")
    got = {tuple(sorted((named[p.a], named[p.b]))) for p in nearcopies._close(nearcopies._prefix_pairs(nodes, table), table).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    least = {s: max(i for i in range(len(sets)) if sets[i] == s) for s in sets}
    want = {tuple(sorted((least[sets[i]], least[sets[j]]))) for i, j in want}
    top = {x: least[sets[x]] for x in named.values()}
    assert {tuple(sorted((top[a], top[b]))) for a, b in got} == want and len(want) > 100


def test_candidates_by_fingerprints(spark, monkeypatch):
    """What no band brings together comes by fingerprints of 2 bits or fewer apart, and counts only at 0.8."""
    monkeypatch.setattr(nearcopies, "_sketches", lambda rows, f=nearcopies._sketches: f(rows).withColumn("keys", F.array().cast("array<long>")))
    base = [f"w{i}" for i in range(4_000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{i}" for i in range(4_000)), "one two", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(docs).collect()) == [0, 2, 3, 4]


def test_pairs_of_fingerprints(spark):
    nodes = spark.createDataFrame([(1, 9, 5), (2, 9, 5), (3, 9, 6), (4, 9, 1 << 40), (7, 0, 0)], "node long, n long, fp long")
    assert {tuple(r) for r in nearcopies._fingerprint_pairs(nodes).collect()} == {(1, 2), (1, 3)}
