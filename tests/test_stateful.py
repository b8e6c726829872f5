"""State by key: merges against the plain evaluator, restarts, and sessions that fall silent."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_merge import OWN, SESSION, evaluate, grid

from tidemark.functions.scope import Filter
from tidemark.operators import merge
from tidemark.plans.derive import Tables
from tidemark.sources.pages import stream_pages, write_pages
from tidemark.sources.snapshots import Snapshots
from tidemark.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(grid()))
def test_rules_of_a_record(name):
    mine, has, theirs, got = grid()[name]
    if theirs is None:
        return
    row = None
    if mine:
        row = dict(zip(("last_saved_instance", "last_saved_counter", "serialized", "conflicting_serialized_data", "deleted"), mine, strict=True)) | {"id": name, "hard_deleted": False, "profile": "f", "model_name": "m", "partition": "p", "source_id": "x", "self_ref_fk": ""}
        has = {**has, mine[0]: max(mine[1], has.get(mine[0], 0))}
    came = dict(zip(("last_saved_instance", "last_saved_counter", "serialized", "deleted", "hard_deleted"), theirs, strict=True)) | {"model_uuid": name, "transfer_session_id": SESSION, "conflicting_serialized_data": "", "profile": "f", "model_name": "m", "partition": "p", "source_id": "x", "self_ref_fk": ""}
    got = {**got, theirs[0]: max(theirs[1], got.get(theirs[0], 0))}
    kind, want, vector = evaluate(grid()[name])
    assert stateful.kind_of(row, has, came, got) == kind
    if kind != merge.REVERSE_FF:
        after, seen = stateful.merged(row, has, came, got, kind, OWN, 40)
        assert (after["serialized"], after["conflicting_serialized_data"], after["deleted"], after["hard_deleted"], after["last_saved_instance"], after["last_saved_counter"], after["dirty_bit"], after["deserialization_error"], after["last_transfer_session_id"]) == want
        assert seen == vector


def test_state_outlives_a_restart(spark, tmp_path):
    """Three sessions, a file at a time over two runs: each record's state goes on; a replay changes nothing."""
    t = Tables(spark, SF)
    store, rmc = t.store.cache(), t.rmc.cache()
    buffer, rmcb = (x.cache() for x in t.meeting())
    s = Snapshots(spark, f"{tmp_path}/r")
    s.commit({"store": store, "rmc": rmc})

    def run():
        rows = stream_pages(spark, f"{tmp_path}/x", 1)
        stateful.merge_by_state(rows, s, f"{tmp_path}/c", "i3", 500, Filter(""), "facility").awaitTermination()

    want = store, rmc
    for name in ("m1", "m2", "m3"):
        mine = F.col("transfer_session_id") == name
        write_pages(buffer.where(mine), rmcb.where(mine), f"{tmp_path}/x")
        run()
        want = tuple(x.cache() for x in merge.merge(want[0], buffer, want[1], rmcb, "i3", 500, name))
    columns = store.columns
    rows = lambda df, names: sorted(map(str, df.select(*names).collect()))
    assert rows(s.read("store"), columns) == rows(want[0], columns) and rows(s.read("rmc"), rmc.columns) == rows(want[1], rmc.columns)
    version = s.version
    write_pages(buffer.where("transfer_session_id = 'm3'"), rmcb.where("transfer_session_id = 'm3'"), f"{tmp_path}/x")
    run()
    assert s.version == version


def test_silent_sessions(spark, tmp_path):
    """A session goes once, when time has passed by its last report; who reports again stays."""
    start = datetime(2024, 1, 1)
    got = []

    def report(*rows):
        frame = spark.createDataFrame([(*r[:-1], None) for r in rows], "sync_session_id string, transfer_id string, active boolean, filter string, none string").drop("none")
        at = [start + timedelta(hours=r[-1]) for r in rows]
        frame = spark.createDataFrame([(*r[:-1], str(a)) for r, a in zip(rows, at, strict=True)], "sync_session_id string, transfer_id string, active boolean, filter string, at string")
        frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/x")

    def run():
        stream = spark.readStream.schema(stateful.ACTIVITY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/x")
        each = lambda batch, n: got.extend((r.kind, r.id) for r in batch.collect())
        stateful.expiring(stream, 6, "n1").writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    tick = lambda hour: report((None, None, False, None, hour))
    report(("a", None, True, None, 0), ("a", "t1", True, "n1:x", 0), ("a", "t2", True, "n2", 0), ("b", None, True, None, 1), ("b", "t3", True, "n1", 1), ("c", None, False, None, 0), ("c", "t4", True, "n1", 0))
    tick(6)
    tick(6)
    run()
    assert got == []  # six hours are not more than six hours
    report(("b", "t3", True, "n1", 7))
    tick(8)
    tick(8)
    run()
    assert got == [("transfer", "t1")]  # t2 is outside the filter and keeps its session; b's transfer reported; c isn't active
    tick(14)
    tick(14)
    run()
    assert sorted(got[1:]) == [("sync", "b"), ("transfer", "t3")]
    report(("a", "t2", False, "n2", 15))
    tick(30)
    tick(30)
    run()
    assert got[3:] == [("sync", "a")]


def test_partitions_of_state(spark, tmp_path):
    """State is dealt by what there is and what runs at once, not by the session's number for large shuffles."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "33")
    try:
        reports = spark.createDataFrame([("s", None, True, None)], "sync_session_id string, transfer_id string, active boolean, filter string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
        reports.write.parquet(f"{tmp_path}/r")
        stream = stateful.expiring(spark.readStream.schema(stateful.ACTIVITY).parquet(f"{tmp_path}/r"))
        writer = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True)
        stateful.started(writer, spark).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "33"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in (tmp_path / "c/state/0").iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism


def test_a_group_is_read_and_written_once():
    """Records of a group share their calls for state; records that nothing changes stay as they are."""
    calls = []

    class Kept:
        text = None

        def get(self):
            calls.append("get")
            return self.text and (self.text,)

        def update(self, value):
            calls.append("update")
            self.text = value[0]

    def row(name, counter, session="t1"):
        plain = {"profile": "f", "model_name": "m", "partition": "p", "source_id": "x", "self_ref_fk": "", "serialized": f"{name}{counter}", "deleted": False, "hard_deleted": False, "conflicting_serialized_data": ""}
        return Row(record=json.dumps(plain | {"transfer_session_id": session, "model_uuid": name, "last_saved_instance": "a", "last_saved_counter": counter, "entries": [{"instance_id": "a", "counter": counter}]}))

    processor = stateful.Merging("me", 9)
    processor._kept = Kept()
    names = [f"abcd{i}" for i in range(50)]
    first = [json.loads(r["record"]) for r in processor.handleInputRows(("abcd",), iter(row(n, 2) for n in names), None)]
    assert calls == ["get", "update"] and [r["id"] for r in first] == names
    second = [json.loads(r["record"]) for r in processor.handleInputRows(("abcd",), iter([row("abcd1", 1), row("abcd2", 3), row("abcd2", 4, "t2")]), None)]
    assert [(r["id"], r["serialized"], r["vector"], r["last_transfer_session_id"]) for r in second] == [("abcd2", "abcd24", {"a": 4}, "t2")]
    assert list(processor.handleInputRows(("abcd",), iter([row("abcd3", 2)]), None)) == []
    assert calls == ["get", "update"] * 2 + ["get"]
    assert sorted((r["id"], r["serialized"]) for r in json.loads(processor._kept.text)) == sorted((n, "abcd24" if n == "abcd2" else f"{n}2") for n in names)


def test_groups_of_ids(spark):
    """Neighbours share a group; ids that aren't digits are dealt by their hash and not by what they begin with."""
    ids = spark.createDataFrame([(f"0123{i:028x}",) for i in range(5)] + [(f"order-{i}",) for i in range(40)], "id string")
    got = {r.id: r.group for r in ids.select("id", stateful.group_of("id")).collect()}
    assert {g for i, g in got.items() if i[0] == "0"} == {"0123"} and len({g for i, g in got.items() if i[0] == "o"}) > 30
