from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scope import Filter, Scope
from tidemark.operators import summary
from tidemark.operators.capture import ForeignKey, Model, Registry, captured
from tidemark.operators.exchange import InvalidTransfer, received
from tidemark.plans.replica import NotAllowed, Replica, Transfer, pull, push
from tidemark.operators.restore import PARENT_DIRTY, PARENT_MISSING
from tidemark.schemas import DIRTY
from tidemark.sources.snapshots import Snapshots


def models():
    text = T.StringType()
    user = Model("user", T.StructType([T.StructField("id", text), T.StructField("username", text, True, {"max_length": 20, "not_blank": True}), T.StructField("is_staff", T.BooleanType())]), source_id=F.col("username"), partition=F.lit("${id}:user"), skipped=frozenset({"id"}), defaults={"is_staff": F.lit(False)})
    log = lambda name, nullable: Model(name, T.StructType([T.StructField("id", text), T.StructField("user_id", text), T.StructField("content_id", text)]), (ForeignKey("user_id", "user", nullable),), F.concat_ws(":", "user_id", "content_id"), F.concat(F.coalesce("user_id", F.lit("x")), F.lit(":user:" + name)), skipped=frozenset({"id"}))
    facility = Model("facility", T.StructType([T.StructField("id", text), T.StructField("name", text), T.StructField("parent_id", text)]), (ForeignKey("parent_id", "facility"),), F.col("name"), F.lit(""), skipped=frozenset({"id"}))
    return [log("summary", False), log("interaction", True), user, facility]


def replica(spark, name, **more):
    return Replica(spark, models(), "facility", name * 32, **more)


def rows(spark, *values, columns):
    return spark.createDataFrame([(None, *v) for v in values], "id string, " + columns)


def ids(df, key="username"):
    return {r[key]: r.id for r in df.collect()}


def add_user(r, name):
    r.upsert("user", rows(r.spark, (name, False), columns="username string, is_staff boolean"))
    return ids(r.apps["user"])[name]


def add_logs(r, model, user, n, start=0):
    r.upsert(model, rows(r.spark, *[(user, f"{i:032x}") for i in range(start, start + n)], columns="user_id string, content_id string"))


def payloads(r):
    return {x.id: json.loads(x.serialized) for x in r.store.collect()}


def tamper(r, record, **changes):
    """Change a store row as if a transfer had brought it."""
    text = changes.pop("payload", None)
    for c, v in ({"dirty_bit": True} | changes | ({"serialized": json.dumps(text)} if text is not None else {})).items():
        r.store = r.store.withColumn(c, F.when(F.col("id") == record, F.lit(v)).otherwise(F.col(c)))


def test_push_pull_and_repeat(spark):
    a, b = replica(spark, "a"), replica(spark, "b")
    bob = add_user(a, "bob")
    add_logs(a, "summary", bob, 5)
    add_logs(a, "interaction", bob, 5)
    t = Transfer(a, b, Filter(""), push=True, page=3).run()
    assert (t.records_total, t.records_transferred, t.stage, t.status) == (11, 11, "cleanup", "completed")
    assert ids(b.apps["user"]) == {"bob": bob} and b.apps["summary"].count() == 5 and b.apps["interaction"].count() == 5
    assert not b.apps["summary"].where(DIRTY).count() and not a.store.where("dirty_bit").count() and a.buffer.isEmpty() and b.buffer.isEmpty()
    assert push(a, b, Filter("")).records_total == 0
    assert pull(a, b, Filter("")).records_total == 0
    add_logs(b, "summary", bob, 2, 5)
    assert pull(a, b, Filter(f"{bob}:user")).records_transferred == 2 and a.apps["summary"].count() == 7


def test_partial_filter_and_resume(spark):
    a, b = replica(spark, "a"), replica(spark, "b")
    bob, eve = add_user(a, "bob"), add_user(a, "eve")
    add_logs(a, "summary", bob, 2)
    add_logs(a, "summary", eve, 2)
    seen = []
    t = Transfer(a, b, Filter(f"{bob}:user"), push=True, hooks=[lambda stage, status: seen.append((stage, status))]).run(until="queuing")
    assert t.stage == "queuing" and t.records_total == 3
    t.run()
    assert seen[0] == ("initializing", "started") and seen[-1] == ("cleanup", "completed")
    assert set(ids(b.apps["user"])) == {"bob"} and b.apps["summary"].count() == 2


def test_transfer_goes_on_after_a_restart(spark, tmp_path):
    """Both sides and the transfer come back from their snapshots, and it ends as if nothing had happened."""
    a, b = replica(spark, "a"), replica(spark, "b")
    bob = add_user(a, "bob")
    add_logs(a, "summary", bob, 2)
    t = Transfer(a, b, Filter(""), push=True, page=2).run(until="queuing")
    kept = [Snapshots(spark, str(tmp_path / x)) for x in "ab"]
    a.save(kept[0], [t])
    b.save(kept[1])
    a2, b2 = (Replica.load(s, models()) for s in kept)
    again = Transfer.resume(a2, b2, kept[0].read("transfers").first(), kept[0].read("vectors"))
    assert (again.id, again.stage, again.records_total) == (t.id, "queuing", 3) and a2.counter == a.counter
    again.run()
    assert again.stage == "cleanup" and set(ids(b2.apps["user"])) == {"bob"} and b2.apps["summary"].count() == 2
    assert push(a2, b2, Filter("")).records_total == 0


def test_registry_and_dirty_rule(spark):
    registry = Registry(facility=models())
    names = [m.name for m in registry.models("facility")]
    assert names.index("user") < names.index("summary") and registry.model("facility", "user").name == "user" and registry.models("other") == []
    a = replica(spark, "a")
    bob = add_user(a, "bob")
    a.serialize()
    row = spark.createDataFrame([(bob, "bob", True)], "id string, username string, is_staff boolean")
    a.upsert("user", row, dirty=None)
    assert not a.apps["user"].first()[DIRTY]  # as it was
    a.upsert("user", row)
    a.upsert("user", row, dirty=False)
    assert not a.apps["user"].first()[DIRTY] and a.apps["user"].first().is_staff


def test_scopes_bound_transfers(spark):
    a, b = replica(spark, "a", scope=Scope(read_write="p")), replica(spark, "b", scope=Scope(read_write="p"))
    with pytest.raises(NotAllowed):
        push(a, b, Filter("q"))


def test_conflict_and_unknown_keys(spark):
    a, b = replica(spark, "a"), replica(spark, "b")
    bob = add_user(a, "bob")
    push(a, b, Filter(""))
    for r, staff in ((a, True), (b, False)):
        r.upsert("user", r.spark.createDataFrame([(bob, "bob", staff)], "id string, username string, is_staff boolean"))
    tamper(a, bob, payload={"username": "bob", "is_staff": False, "extra": 6}, dirty_bit=False)
    b.serialize()
    push(a, b, Filter(""))
    row = b.store.where(F.col("id") == bob).first()
    assert json.loads(row.serialized)["is_staff"] is False and row.last_saved_instance == b.instance_id
    other = json.loads(row.conflicting_serialized_data.split("\n")[0])
    assert other == {"username": "bob", "is_staff": True, "extra": 6}  # unknown keys survive a capture
    pull(a, b, Filter(""))  # the merge is a save that goes back and fast-forwards
    assert payloads(a)[bob] == payloads(b)[bob] and a.apps["user"].first().is_staff is False


def test_deletes(spark):
    a, b = replica(spark, "a"), replica(spark, "b")
    bob = add_user(a, "bob")
    add_logs(a, "summary", bob, 2)
    push(a, b, Filter(""))
    a.delete("user", a.apps["user"])
    push(a, b, Filter(""))
    assert b.apps["user"].isEmpty() and b.apps["summary"].isEmpty() and b.store.where("deleted").count() == 1
    eve = add_user(a, "eve")
    a.serialize()
    a.delete("user", a.apps["user"], erase=True)
    a.serialize()
    row = a.store.where(F.col("id") == eve).first()
    assert (row.deleted, row.hard_deleted, row.serialized) == (True, True, "{}")
    add_user(a, "eve")
    a.serialize()
    row = a.store.where(F.col("id") == eve).first()
    assert (row.deleted, row.hard_deleted) == (False, False)  # made anew


def test_reference_to_deleted_is_deleted_next_time(spark):
    a = replica(spark, "a")
    bob = add_user(a, "bob")
    add_logs(a, "summary", bob, 1)
    a.serialize()
    log = a.apps["summary"].first().id
    tamper(a, bob, deleted=True, dirty_bit=False)
    tamper(a, log)
    a.deserialize()
    assert {r.id for r in a.deleted.collect()} == {log}
    a.serialize()
    assert a.store.where(F.col("id") == log).first().deleted


@pytest.mark.parametrize(
    "model, change, message",
    [
        ("summary", {"user_id": "e" * 32}, "no user has the id " + "e" * 32),
        ("summary", {"user_id": None}, "cannot be null"),
        ("interaction", {"user_id": None}, ""),
        ("summary", {}, ""),
        ("user", {"username": ""}, "blank"),
        ("user", {"username": "x" * 256}, "at most 20"),
    ],
)
def test_validation(spark, model, change, message):
    a = replica(spark, "a")
    bob = add_user(a, "bob")
    add_logs(a, "summary", bob, 1)
    add_logs(a, "interaction", bob, 1)
    a.serialize()
    record = a.apps[model].first().id
    tamper(a, record, payload=payloads(a)[record] | change)
    a.deserialize()
    row = a.store.where(F.col("id") == record).first()
    assert row.dirty_bit == bool(message) and message in row.deserialization_error
    if not message:
        assert a.apps[model].where(F.col("id") == record).count() == 1


def facilities(a, *pairs):
    for name, parent in pairs:
        known = ids(a.apps["facility"], "name")
        a.upsert("facility", rows(a.spark, (name, known.get(parent)), columns="name string, parent_id string"))
    return ids(a.apps["facility"], "name")


def test_levels(spark):
    a, b = replica(spark, "a"), replica(spark, "b")
    f = facilities(a, ("root", None), ("child", "root"), ("grandchild", "child"), ("other", "root"))
    push(a, b, Filter(""))
    assert ids(b.apps["facility"], "name") == f and b.apps["facility"].where("name = 'grandchild'").first().parent_id == f["child"]
    tamper(b, f["child"], deleted=True)
    local = facilities(b, ("late", "child"))
    b.deserialize()
    assert set(ids(b.apps["facility"], "name")) == {"root", "other"} and "late" in local


@pytest.mark.parametrize("matching", [True, False])
def test_missing_parent(spark, matching):
    a = replica(spark, "a")
    f = facilities(a, ("root", None), ("child", "root"))
    a.serialize()
    tamper(a, f["child"], payload={"name": "child", "parent_id": "b" * 32}, **({"self_ref_fk": "b" * 32} if matching else {}))
    a.deserialize()
    row = a.store.where(F.col("id") == f["child"]).first()
    assert row.dirty_bit and ("has the id" in row.deserialization_error or row.deserialization_error == PARENT_MISSING)


def test_dirty_parent(spark):
    a = replica(spark, "a")
    f = facilities(a, ("root", None), ("child", "root"))
    a.serialize()
    tamper(a, f["root"], serialized="no json")
    tamper(a, f["child"])
    a.deserialize()
    error = {r.id: r.deserialization_error for r in a.store.collect()}
    assert "JSON" in error[f["root"]] and error[f["child"]] == PARENT_DIRTY


def test_received_records_are_checked(spark):
    a, b = replica(spark, "a"), replica(spark, "b")
    bob = add_user(a, "bob")
    t = Transfer(a, b, Filter(""), push=True).run(until="queuing")
    from tidemark.operators.exchange import nested

    wire = nested(a.buffer, a.rmcb)
    assert received(wire, t.id, Filter(""), "facility")[0].count() == 1
    for bad, filters in ((wire.withColumn("source_id", F.lit("x")), ""), (wire, "elsewhere"), (wire.withColumn("rmcb_list", F.transform("rmcb_list", lambda r: r.withField("model_uuid", F.lit("z")))), "")):
        with pytest.raises(InvalidTransfer):
            received(bad, t.id, Filter(filters), "facility")
    kept, _, refused = received(wire.union(wire.withColumn("source_id", F.lit("x"))), t.id, Filter(""), "f2", quarantine=True)
    assert kept.first().profile == "f2" and refused.count() == 1 and bob


def test_three_replicas_converge(spark):
    r = random.Random(5)
    group = [replica(spark, c) for c in "abc"]
    for step in range(3):
        for x in group:
            x.upsert("user", rows(spark, *[(f"u{r.randrange(4)}", bool(r.randrange(2)))], columns="username string, is_staff boolean"))
        a, b = r.sample(group, 2)
        push(a, b, Filter(""))
    for _ in range(2):
        for a, b in ((0, 1), (1, 2), (2, 0)):
            push(group[a], group[b], Filter(""))
            pull(group[a], group[b], Filter(""))
    first = payloads(group[0])
    assert first and all(payloads(x) == first for x in group[1:])
    assert all({u.username: u.is_staff for u in x.apps["user"].collect()} == {p["username"]: p["is_staff"] for p in first.values()} for x in group)


def counts(df):
    return sorted(tuple(r) for r in df.select("kind", "partition", "instance_id", "records").where("records > 0").collect())


def test_summary_is_kept(spark, tmp_path):
    """After captures, deletions, merges with conflicts, a save and a load the kept counts are those of a whole count."""
    a, b = replica(spark, "a"), replica(spark, "b")
    ann = add_user(a, "ann")
    add_logs(a, "interaction", ann, 3)
    push(a, b, Filter(""))
    for r, name in ((a, "of a"), (b, "of b")):
        r.upsert("user", spark.createDataFrame([(ann, name, False)], "id string, username string, is_staff boolean").withColumns({c: F.lit(None).cast("string") for c in ("_source_id", "_partition")}))
    add_user(b, "bob")
    b.delete("interaction", b.apps["interaction"].limit(1))
    went = pull(a, b, Filter(""))
    assert went.bytes_transferred > 0 and went.records_transferred == went.records_total > 0
    push(a, b, Filter(""))
    for r in (a, b):
        assert r.summary is not None and counts(r.summary) == counts(summary.counted(r.store, r.rmc))
    s = Snapshots(spark, str(tmp_path / "a"))
    a.save(s)
    again = Replica.load(s, models())
    again.serialize()
    assert counts(again.summary) == counts(summary.counted(again.store, again.rmc))


def scanned(df):
    """Rows that the scans of a plan gave."""
    session = df.sparkSession
    before = session.conf.get("spark.sql.adaptive.enabled")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return {str(leaves.apply(i).output()): leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows")}
    finally:
        session.conf.set("spark.sql.adaptive.enabled", before)


def test_capture_reads_dirty_rows_alone(spark, tmp_path):
    """Of a saved table with ten dirty rows a capture reads ten, also where changes came after."""
    user = models()[2]
    r = replica(spark, "a")
    r.upsert("user", rows(spark, *[(f"u{i}", False) for i in range(3_000)], columns="username string, is_staff boolean"))
    r.serialize()
    r.upsert("user", rows(spark, *[(f"u{i}", True) for i in range(10)], columns="username string, is_staff boolean"))
    s = Snapshots(spark, str(tmp_path / "r"))
    r.save(s)
    table = s.read("app-user")
    assert table.count() == 3_000 and list(scanned(table.where(DIRTY)).values()) == [10]
    assert sum(n for out, n in scanned(captured(table, user, s.read("store").limit(0), "facility", r.instance_id, 9)).items() if DIRTY in out) in (10, 20)
    assert scanned(s.read("store").where("dirty_bit")) == {} or sum(scanned(s.read("store").where("dirty_bit")).values()) == 0
    again = Replica.load(s, models())
    again.serialize()
    assert again.store.where("serialized like '%true%'").count() == 10 and again.apps["user"].where(DIRTY).isEmpty()


def test_what_a_profile_says_of_itself():
    known = Registry({"facility": {"app": "learning", "version": "2"}}, facility=models(), other=[])
    assert known.instance_info("facility") == {"app": "learning", "version": "2"} and known.instance_info("other") == {} == known.instance_info("none")
    known.instance_info("facility")["app"] = "changed"
    assert known.instance_info("facility")["app"] == "learning" and len(known.models("facility")) == 4
