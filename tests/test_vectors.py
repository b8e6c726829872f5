"""Vector operators against plain evaluators of their rules, over random vectors and a few edge cases."""

from __future__ import annotations

import random

import pytest

from tidemark.functions.scope import Filter
from tidemark.operators import merge, outgoing, vectors

PART = "partition string, instance_id string, counter int"


def some_parts(r, n):
    """Names of which many are prefixes of others."""
    return ["".join(r.choice("uv:") for _ in range(r.randrange(0, 5))) for _ in range(n)]


def some_vector(r, parts, high=12):
    return {(p, i): r.randrange(1, high) for p in parts for i in "xyz" if r.random() < 0.6}


def table(spark, vector):
    return spark.createDataFrame([(p, i, c) for (p, i), c in vector.items()], PART)


def found(df):
    out = {}
    for r in df.select("partition", "instance_id", "counter").collect():
        assert (r.partition, r.instance_id) not in out
        out[r.partition, r.instance_id] = r.counter
    return out


def some_wire(r):
    """(side, partition, instance, counter) rows; some partitions have no entry."""
    rows = []
    for side in ("sub", "super"):
        for p in sorted(set(some_parts(r, 5))):
            rows += [(side, p, i, c) for (_, i), c in some_vector(r, [p]).items()] or [(side, p, None, None)]
    return rows


def highest(entries):
    out = {}
    for p, i, c in entries:
        out[p, i] = max(c, out.get((p, i), c))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_expanded(spark, seed):
    r = random.Random(seed)
    rows, filters = some_wire(r), sorted(set(some_parts(r, 3)))
    parts = {p for side, p, *_ in rows if side == "sub"} | set(filters)
    tops = [p for p in parts if not any(p != q and p.startswith(q) for q in parts)]
    own = [(p, i, c) for side, p, i, c in rows if side == "sub" and i]
    handed = [(t, i, c) for t in tops for side, p, i, c in rows if side == "super" and i and t.startswith(p)]
    assert found(vectors.expanded(spark.createDataFrame(rows, vectors.WIRE), filters)) == highest(own + handed)


@pytest.mark.parametrize("seed", range(5))
def test_without_redundant(spark, seed):
    rows = some_wire(random.Random(seed + 50))
    covers = lambda a, b: a[2] == b[2] and a[1] != b[1] and b[1].startswith(a[1]) and a[3] >= b[3]
    entries = [x for x in rows if x[2]]
    left = [b for b in entries if not any(covers(a, b) for a in entries)]
    empty = {(s, p, None, None) for s, p, *_ in rows} - {(s, p, None, None) for s, p, *_ in left}
    got = vectors.without_redundant(spark.createDataFrame(rows, vectors.WIRE)).select("side", "partition", "instance_id", "counter")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, set(left) | empty))


@pytest.mark.parametrize("seed", range(5))
def test_diff(spark, seed):
    r = random.Random(seed + 100)
    sent, had = some_vector(r, set(some_parts(r, 8))), some_vector(r, set(some_parts(r, 8)))
    if seed == 0:
        had = dict(sent)
    reach = lambda p, i: max((c for (q, j), c in had.items() if j == i and p.startswith(q)), default=0)
    assert found(vectors.diff(table(spark, sent), table(spark, had))) == {(p, i): reach(p, i) for (p, i), c in sent.items() if reach(p, i) < c}


@pytest.mark.parametrize("seed", range(6))
def test_flat_vectors(spark, seed):
    r = random.Random(seed + 150)
    dmc, filters = some_vector(r, set(some_parts(r, 9))), sorted({p + "u" for p in some_parts(r, 1 + seed % 3)})
    each = [highest([("", i, c) for (p, i), c in dmc.items() if f.startswith(p)]) for f in filters]
    names = {i for e in each for _, i in e}
    for producer in (True, False):
        rows = {k.instance_id: k.counter for k in vectors.flat_vector(table(spark, dmc), filters, producer).collect()}
        if producer:
            assert rows == {i: max(e["", i] for e in each if ("", i) in e) for i in names}
        else:
            assert rows == {i: min(e["", i] for e in each) for i in names if all(("", i) in e for e in each)}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8])
def test_chunks(spark, size):
    r = random.Random(size)
    vector = some_vector(r, set(some_parts(r, 7)))
    got = vectors.chunks(table(spark, vector), size)
    flat = [(p, i, c) for chunk in got for p, e in chunk.items() for i, c in e.items()]
    assert flat == sorted((p, i, c) for (p, i), c in vector.items())
    weight = lambda chunk: len(chunk) + sum(map(len, chunk.values()))
    assert all(weight(c) <= max(size, 2) for c in got)
    for a, b in zip(got, got[1:], strict=False):
        following = next(iter(b))
        assert weight(a) + (1 if following in a else 2) > size  # the next entry had no room


def test_text_of_large_vectors(spark):
    """Nothing is cut off, however many entries there are."""
    n = 210_000
    wide = spark.range(n).selectExpr("'sub' as side", "concat('p', id div 70) as partition", "concat('i', id % 70) as instance_id", "cast(id + 1 as int) as counter")
    empty = spark.createDataFrame([("super", "p", None, None)], vectors.WIRE)
    text = vectors.to_json(wide.unionByName(empty))
    back = vectors.from_json(spark, text)
    assert back.count() == n + 1 and back.agg({"counter": "sum"}).first()[0] == n * (n + 1) // 2
    with pytest.raises(vectors.LimitExceeded):
        vectors.chunks(wide, 200)


def test_reachable(spark):
    r = random.Random(9)
    dmc = some_vector(r, set(some_parts(r, 10)))
    pairs = [(p, r.choice("xyz")) for p in some_parts(r, 12)]
    got = found(vectors.reachable(table(spark, dmc), spark.createDataFrame(pairs, "partition string, instance_id string")))
    assert got == {(p, i): c for (p, i), c in dmc.items() if any(j == i and q.startswith(p) for q, j in pairs)}


def test_counter_updates(spark):
    r = random.Random(11)
    dmc, came = some_vector(r, ["k", "kk", "m"]), some_vector(r, ["k", "m", "n"])
    wire = spark.createDataFrame([("sub", p, i, c) for (p, i), c in came.items()] + [("sub", "o", None, None), ("super", "", "x", 99)], vectors.WIRE)
    both = {k: max(dmc.get(k, 0), came.get(k, 0)) for k in dmc.keys() | came.keys()}
    assert found(merge.dmc_with_parts(table(spark, dmc), wire)) == both
    assert found(merge.dmc_with_parts(table(spark, dmc), wire, overwrite=True)) == dmc | came
    vector, own = {"x": 7, "y": 3, "w": 5}, {"x": 2, "y": 3}
    rows = lambda v: spark.createDataFrame(list(v.items()), "instance_id string, counter int")
    want = dict(dmc)
    for f in ("k", "new"):
        for i in ("x", "w"):  # of y no more is promised than was there
            want[f, i] = max(vector[i], want.get((f, i), 0))
    assert found(merge.dmc_with_flat(table(spark, dmc), rows(vector), rows(own), ["k", "new"])) == want


def test_queue(spark):
    """Rows above a bound of their instance whose partition is a prefix, each once."""
    r = random.Random(13)
    store = [(f"r{n}", "f", p, r.choice("xyz"), r.randrange(1, 12)) for n, p in enumerate(some_parts(r, 80))]
    bounds = some_vector(r, set(some_parts(r, 9))) | {("uuuuuuuuuuuu", "x"): 1}
    df = spark.createDataFrame(store, "id string, profile string, partition string, last_saved_instance string, last_saved_counter int")
    queued = outgoing.queue(df, table(spark, bounds), "f")
    want = sorted(i for i, _, p, who, c in store if any(j == who and p.startswith(q) and c > low for (q, j), low in bounds.items()))
    assert want and sorted(k.id for k in queued.collect()) == want
    assert outgoing.queue(df, table(spark, bounds), "other").isEmpty()
    plan = queued._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "StartsWith" not in plan


def test_limits_and_partitions(spark):
    wire = lambda *rows: spark.createDataFrame(rows, vectors.WIRE)
    with pytest.raises(outgoing.PartitionOutsideFilter):
        outgoing.check_partitions(wire(("sub", "zz", "x", 1)), Filter("k"))
    outgoing.check_partitions(wire(("super", "", "x", 1), ("sub", "k:7", "x", 1)), Filter("k"))
    store = spark.createDataFrame([("r", "f", "k", "x", 1)], "id string, profile string, partition string, last_saved_instance string, last_saved_counter int")
    many = spark.range(vectors.ENTRY_LIMIT).selectExpr("cast(id as string) as instance_id", "0 as counter")
    with pytest.raises(vectors.LimitExceeded):
        outgoing.queue_flat(store, many, ["k"], "f")
    assert outgoing.queue_flat(store, many.limit(10).union(spark.sql("select 'x', 0")), ["k"], "f").count() == 1
    wide = spark.range(vectors.PART_ENTRY_LIMIT // 2).selectExpr("concat('k', id) as partition", "'x' as instance_id", "0 as counter")
    with pytest.raises(vectors.LimitExceeded):
        outgoing.queue(store, wide, "f")


def test_queue_of_many_bounds(spark):
    """A store's own question has no limit: bounds beyond the protocol's give the rows that the definition gives."""
    n = vectors.PART_ENTRY_LIMIT
    wide = spark.range(n).selectExpr("concat('k', id, ':') as partition", "concat('i', id % 3) as instance_id", "cast(id % 7 as int) as counter")
    wide = wide.union(spark.sql("select 'k1', 'i0', 5"))
    rows = [(f"r{j}", p, f"k{k}:x" if k is not None else None, f"i{j % 3}", c) for j, (k, c, p) in enumerate([(1, 3, "f"), (10, 6, "f"), (10, 5, "f"), (99799, 9, "f"), (99799, 9, "g"), (100000, 9, "f"), (2, 2, "f"), (1, 1, "f"), (5, 6, "f"), (None, 9, "f")])]
    store = spark.createDataFrame(rows, "id string, profile string, partition string, last_saved_instance string, last_saved_counter int")
    bounds = {(f"k{k}:", f"i{k % 3}"): k % 7 for k in range(n)} | {("k1", "i0"): 5}
    want = sorted(i for i, p, path, who, c in rows if p == "f" and path and any(c > bounds.get((path[:m], who), 1 << 30) for m in range(len(path) + 1)))
    got = outgoing.queue(store, wide, "f", limit=None)
    assert got.columns == store.columns and sorted(r.id for r in got.collect()) == want
    assert want


def test_pairs_of_rows_with_their_vectors(spark):
    """The same pairs as of store and vectors apart."""
    held = spark.createDataFrame([("r1", "p", [("a", 1), ("b", 2)]), ("r2", "q", [("a", 3)])], "id string, partition string, entries array<struct<instance_id: string, counter: int>>")
    rmc = held.selectExpr("id", "inline(entries)")
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (vectors.list_pairs(held), vectors.vector_pairs(held, rmc)))
    assert got == want == [("p", "a"), ("p", "b"), ("q", "a")]
