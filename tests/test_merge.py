"""Merging against a plain evaluator of the four rules, over a grid of vectors and flags."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import exchange, merge
from tidemark.operators.capture import replaced
from tidemark.schemas import BUFFER, RMC, RMCB, STORE

OWN, SESSION, CLOCK = "me", "s1", 40
PLAIN = {"profile": "f", "model_name": "m", "partition": "p", "source_id": "x", "self_ref_fk": ""}


def grid():
    """(store row or None, its vector, buffer row or None, its vector) of every case, by record id."""
    cases = {}
    for n, (has, got, mine, theirs, deleted, hard) in enumerate(itertools.product(({"k": 2}, {"k": 5, "q": 1}), ({"k": 3}, {"q": 4}, {"k": 2, "q": 4, OWN: 7}), (("k", 2), ("q", 3)), (("k", 3), ("q", 4)), (False, True), (False, True))):
        cases[f"r{n}"] = ((*mine, "own text", "aside" * (n % 2), not deleted and n % 3 == 0), has, (*theirs, "" if hard else "their text", deleted, hard), got)
    cases["new"] = (None, {}, ("k", 1, "their text", False, False), {"k": 1, "q": 9})
    cases["alone"] = (("k", 2, "own text", "", False), {"k": 2}, None, {})
    return cases


def evaluate(case):
    """(class, store row without identity, vector) after the merge."""
    mine, has, theirs, got = case
    has = {**has, mine[0]: max(mine[1], has.get(mine[0], 0))} if mine else {}
    got = {**got, theirs[0]: max(theirs[1], got.get(theirs[0], 0))} if theirs else {}
    if theirs is None:
        return None, (mine[2], mine[3], mine[4], False, mine[0], mine[1], False, "e", None), has
    taken = (theirs[2], "", theirs[3], theirs[4], theirs[0], theirs[1], True, "", SESSION)
    if mine is None:
        return merge.NEW, taken, got
    if has.get(theirs[0], -1) >= theirs[1]:
        return merge.REVERSE_FF, (mine[2], mine[3], mine[4], False, mine[0], mine[1], False, "e", None), has
    if got.get(mine[0], -1) >= mine[1]:
        return merge.FAST_FORWARD, taken, has | got
    vector = {i: max(has.get(i, 0), got.get(i, 0)) for i in has.keys() | got.keys()} | {OWN: CLOCK}
    texts = ("", "") if theirs[4] else (mine[2], f"{theirs[2]}\n{mine[3]}")
    return merge.CONFLICT, (*texts, mine[4] or theirs[3], theirs[4], OWN, CLOCK, True, "", SESSION), vector


def make(spark, rows, schema):
    return spark.createDataFrame([tuple(r[c] for c in schema.fieldNames()) for r in rows], schema)


@pytest.fixture(scope="module")
def tables(spark):
    store, buffer, rmc, rmcb = [], [], [], []
    for i, (mine, has, theirs, got) in grid().items():
        if mine:
            store.append(PLAIN | {"id": i, "last_saved_instance": mine[0], "last_saved_counter": mine[1], "serialized": mine[2], "conflicting_serialized_data": mine[3], "deleted": mine[4], "hard_deleted": False, "dirty_bit": False, "deserialization_error": "e", "last_transfer_session_id": None})
            rmc += [(i, k, c) for k, c in {**has, mine[0]: max(mine[1], has.get(mine[0], 0))}.items()]
        if theirs:
            buffer.append(PLAIN | {"transfer_session_id": SESSION, "model_uuid": i, "last_saved_instance": theirs[0], "last_saved_counter": theirs[1], "serialized": theirs[2], "conflicting_serialized_data": "", "deleted": theirs[3], "hard_deleted": theirs[4]})
            rmcb += [(SESSION, i, k, c) for k, c in got.items()] + [(SESSION, i, theirs[0], theirs[1])]  # entries of a transfer may repeat
    other = buffer[0] | {"transfer_session_id": "elsewhere", "model_uuid": "not ours"}
    return make(spark, store, STORE), make(spark, [*buffer, other], BUFFER), spark.createDataFrame(rmc, RMC), spark.createDataFrame([*rmcb, ("elsewhere", "not ours", "k", 1)], RMCB)


def test_grid(spark, tables):
    want = {i: evaluate(case) for i, case in grid().items()}
    assert {w[0] for w in want.values()} == {None, merge.NEW, merge.REVERSE_FF, merge.FAST_FORWARD, merge.CONFLICT}
    assert {r.model_uuid: r["class"] for r in merge.classes(*tables, SESSION).collect()} == {i: w[0] for i, w in want.items() if w[0]}
    every = merge.joined(*tables, SESSION)
    whole = merge.merged_store(every, OWN, CLOCK, SESSION), merge.merged_vectors(every, OWN, CLOCK)
    for store, rmc in (whole, merge.merge(*tables, OWN, CLOCK, SESSION)):
        rows = {r.id: r for r in store.collect()}
        vectors = {}
        for r in rmc.collect():
            assert r.instance_id not in vectors.setdefault(r.id, {})
            vectors[r.id][r.instance_id] = r.counter
        assert rows.keys() == vectors.keys() == want.keys()
        for i, (_, row, vector) in want.items():
            s = rows[i]
            assert (s.serialized, s.conflicting_serialized_data, s.deleted, s.hard_deleted, s.last_saved_instance, s.last_saved_counter, s.dirty_bit, s.deserialization_error, s.last_transfer_session_id) == row, i
            assert vectors[i] == vector, i


def test_merging_again_changes_nothing(spark, tables):
    store, buffer, rmc, rmcb = tables
    done, seen = merge.merge(store, buffer, rmc, rmcb, OWN, CLOCK, SESSION)
    assert {x["class"] for x in merge.classes(done, buffer, seen, rmcb, SESSION).collect()} == {merge.REVERSE_FF}
    assert merge.changes(done, buffer, seen, rmcb, OWN, CLOCK + 1, SESSION)[0].isEmpty()


def test_rule_for_conflicts(spark, tables):
    """A model's own rule chooses the text that a conflict keeps, unless the record is erased."""
    store, _ = merge.merge(*tables, OWN, CLOCK, SESSION, lambda s, b: F.concat(F.lit("both: "), s["serialized"], F.lit("|"), b["serialized"]))
    rows = {r.id: r.serialized for r in store.collect()}
    for i, case in grid().items():
        kind, row, _ = evaluate(case)
        assert rows[i] == ("both: own text|their text" if kind == merge.CONFLICT and not case[2][4] else row[0])


def meeting(spark, seed):
    """Random tables in which four sessions bring the same records."""
    draw = random.Random(seed)
    save = lambda: (draw.choice("abc"), draw.randrange(1, 9))
    vector = lambda own: {**{draw.choice("abc"): draw.randrange(1, 9) for _ in range(draw.randrange(3))}, own[0]: own[1]}
    store, buffer, rmc, rmcb = [], [], [], []
    for i in range(120):
        if draw.random() < 0.8:
            own = save()
            store.append(PLAIN | {"id": f"r{i}", "last_saved_instance": own[0], "last_saved_counter": own[1], "serialized": "own", "conflicting_serialized_data": "", "deleted": draw.random() < 0.2, "hard_deleted": False, "dirty_bit": False, "deserialization_error": "e", "last_transfer_session_id": None})
            rmc += [(f"r{i}", k, c) for k, c in vector(own).items()]
        for session in draw.sample(["s1", "s2", "s3", "s4"], draw.randrange(5)):
            own = save()
            buffer.append(PLAIN | {"transfer_session_id": session, "model_uuid": f"r{i}", "last_saved_instance": own[0], "last_saved_counter": own[1], "serialized": f"{session}'s", "conflicting_serialized_data": "", "deleted": draw.random() < 0.2, "hard_deleted": draw.random() < 0.1})
            rmcb += [(session, f"r{i}", k, c) for k, c in vector(own).items()]
    return make(spark, store, STORE), make(spark, buffer, BUFFER), spark.createDataFrame(rmc, RMC), spark.createDataFrame(rmcb, RMCB)


@pytest.mark.parametrize("rule", [None, lambda s, b: F.concat(s["serialized"], F.lit("+"), b["serialized"])])
def test_sessions_at_once_as_one_by_one(spark, rule):
    store, buffer, rmc, rmcb = (x.cache() for x in meeting(spark, 11))
    counters = [("s3", 20), ("s1", 21), ("s4", 22)]  # s2 is left for later
    folded = merge.fold(store, buffer, rmc, rmcb, OWN, counters, rule)
    rows, entries = merge.rows_of(folded)
    at_once = sorted(map(str, replaced(store, rows).collect())), sorted(map(str, replaced(rmc, entries).collect()))
    for session, counter in counters:
        store, rmc = (x.cache() for x in merge.merge(store, buffer, rmc, rmcb, OWN, counter, session, rule))
    assert at_once == (sorted(map(str, store.collect())), sorted(map(str, rmc.collect())))


def test_more_sessions_are_no_more_shuffles(spark):
    tables = meeting(spark, 12)
    shuffles = [merge.fold(*tables, OWN, [(f"s{i}", i) for i in range(n)])._jdf.queryExecution().sparkPlan().toString().count("Exchange hash") for n in (1, 4)]
    plan = lambda n: merge.fold(*tables, OWN, [(f"s{i}", i) for i in range(n)])._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles[0] == shuffles[1] and plan(1) == plan(4)


def test_empty(spark):
    empty = [spark.createDataFrame([], x) for x in (STORE, BUFFER, RMC, RMCB)]
    store, rmc = merge.merge(*empty, OWN, 1, SESSION)
    assert store.count() == 0 and rmc.count() == 0


def test_vectors_are_shuffled_once(spark):
    """Entries go to their record in one exchange, and the greatest counter of an instance counts, whatever came with it."""
    entries = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), ("a", "y", None), ("b", "y", 2), ("a", "y", 5)], "id string, instance_id string, counter int")
    got = merge.vector_maps(entries, "id", "v")
    assert {r.id: r.v for r in got.collect()} == {"a": {"x": 3, "y": 5}, "b": {"y": 2}}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_a_vector_is_sorted_once(spark):
    """Not again for each of its entries, as a lambda that names the sorted array would."""
    rows = spark.createDataFrame([(1, [("x", 1), ("y", 2), ("x", 3)])], "n int, e array<struct<instance_id: string, counter: int>>").select(merge.greatest(F.col("e")).alias("e"))
    assert [tuple(x) for x in rows.first().e] == [("x", 3), ("y", 2)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") + plan.count("array_sort(") == 1


@pytest.mark.parametrize("sessions", [["s3", "s1", "s4"], ["s2"]])
@pytest.mark.parametrize("rule", [None, lambda s, b: F.concat(s["serialized"], F.lit("+"), b["serialized"])])
def test_wire_records_are_folded_with_their_vectors(spark, sessions, rule):
    """As one by one, also where a session has a record twice: the later save counts, with the entries of both."""
    store, buffer, rmc, rmcb = (x.cache() for x in meeting(spark, 13))
    wire = exchange.nested(buffer, rmcb)
    single = len(sessions) == 1
    if not single:
        entry = F.array(*[F.struct(F.lit("d").alias("instance_id"), F.lit(3).alias("counter"), F.col("transfer_session_id"), F.col("model_uuid"))])
        wire = wire.unionByName(wire.where("model_uuid like '%7'").withColumns({"last_saved_counter": F.lit(0), "serialized": F.lit("earlier"), "rmcb_list": entry}))
        rmcb = rmcb.unionByName(buffer.where("model_uuid like '%7'").select("transfer_session_id", "model_uuid", F.lit("d").alias("instance_id"), F.lit(3).alias("counter"))).cache()
    counters = [(name, 20 + i) for i, name in enumerate(sessions)]
    each = merge.gathered(wire, sessions, once=single)
    rows, entries = merge.rows_of(merge.fold_gathered(store, each, rmc, OWN, counters, 1 if single else 6, rule))
    at_once = sorted(map(str, replaced(store, rows).collect())), sorted(map(str, replaced(rmc, entries).collect()))
    for session, counter in counters:
        store, rmc = (x.cache() for x in merge.merge(store, buffer, rmc, rmcb, OWN, counter, session, rule))
    assert at_once == (sorted(map(str, store.collect())), sorted(map(str, rmc.collect())))


def test_records_that_came_once_are_not_shuffled(spark):
    _, buffer, _, rmcb = meeting(spark, 14)
    wire = spark.createDataFrame(exchange.nested(buffer, rmcb).where("transfer_session_id = 's1'").collect(), exchange.nested(buffer, rmcb).schema)
    assert "Exchange" not in merge.gathered(wire, ["s1"], once=True)._jdf.queryExecution().executedPlan().toString()
