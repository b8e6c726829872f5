"""Streams that keep state by key: records' rows and vectors, and a session's last activity.

Both need the RocksDB state store, whose state lies in the checkpoint and so
outlives executors. What is kept for a key is one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scope import Filter
from ..operators import exchange
from ..operators.merge import CONFLICT, FAST_FORWARD, NEW, REVERSE_FF, vector_maps
from ..operators.sessions import STALE_HOURS
from ..schemas import RECORD_COLUMNS, STORE
from ..sources.snapshots import Snapshots

#: State of a group of records: a JSON list of their store rows, each with its vector of instance to counter. A call for
#: state costs more than a record's merge, and a page's ids are neighbours, so records share their calls.
KEPT = T.StructType([T.StructField("records", T.StringType())])
#: A record that a batch changed, as one JSON text; Python is handed columns value by value.
CHANGED = T.StructType([T.StructField("record", T.StringType())])
#: Leading hex digits of an id that name its group: 65,536 groups.
DIGITS = 4
_RECORD = T.StructType([*STORE.fields, T.StructField("vector", T.MapType(T.StringType(), T.IntegerType()))])
_WHOLE = {"ignoreNullFields": "false"}
_STORE = "spark.sql.streaming.stateStore"
#: The state store; a batch saves what it changed, not the store whole.
_SETTINGS = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true"}
_PARTITIONS = "spark.sql.shuffle.partitions"
#: Bytes of a snapshot's tables (Parquet, compressed) that a partition of the state takes.
PARTITION_BYTES = 64 << 20


def _with_rocksdb(spark: SparkSession) -> None:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)


def started(writer: DataStreamWriter, spark: SparkSession, partitions: int | None = None) -> StreamingQuery:
    """Start a stream with state in so many partitions, or in as many as tasks run at once.

    Each partition is opened, and saved, in every batch whether it has rows or not, and
    adaptive execution joins none of them, so the session's number, made for large
    shuffles, costs a small batch most of its time. A stream that is started again
    keeps the number of its checkpoint.
    """
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(partitions or spark.sparkContext.defaultParallelism))
    try:
        return writer.start()  # runs in a copy of the session
    finally:
        spark.conf.set(_PARTITIONS, before)


def kind_of(mine: dict | None, has: dict[str, int], theirs: dict, got: dict[str, int]) -> str:
    """The class of a received record (see operators.merge)."""
    if mine is None:
        return NEW
    if has.get(theirs["last_saved_instance"], -1) >= theirs["last_saved_counter"]:
        return REVERSE_FF
    return FAST_FORWARD if got.get(mine["last_saved_instance"], -1) >= mine["last_saved_counter"] else CONFLICT


def merged(mine: dict | None, has: dict[str, int], theirs: dict, got: dict[str, int], kind: str, instance_id: str, counter: int) -> tuple[dict, dict[str, int]]:
    """(store row, vector) after a merge of that kind, other than one that drops what came."""
    touched = {"dirty_bit": True, "deserialization_error": "", "last_transfer_session_id": theirs["transfer_session_id"]}
    if kind != CONFLICT:
        return {"id": theirs["model_uuid"]} | {c: theirs[c] for c in RECORD_COLUMNS} | touched, has | got
    hard = theirs["hard_deleted"]
    row = mine | touched | {
        "serialized": "" if hard else mine["serialized"], "conflicting_serialized_data": "" if hard else f"{theirs['serialized']}\n{mine['conflicting_serialized_data']}",
        "deleted": mine["deleted"] or theirs["deleted"], "hard_deleted": mine["hard_deleted"] or hard, "last_saved_instance": instance_id, "last_saved_counter": counter,
    }
    return row, {i: max(has.get(i, 0), got.get(i, 0)) for i in has.keys() | got.keys()} | {instance_id: counter}


def group_of(record: str) -> Column:
    """The group of a record's id: its first digits, or those of its hash if it isn't one itself."""
    c = F.col(record)
    return F.substring(F.when(c.rlike(f"^[0-9a-f]{{{DIGITS}}}"), c).otherwise(F.md5(c)), 1, DIGITS).alias("group")


class Merging(StatefulProcessor):
    """Keeps the store rows and vectors of a group of records, and gives those that a batch changes."""

    def __init__(self, instance_id: str, counter: int):
        self.instance_id, self.counter = instance_id, counter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getValueState("kept", KEPT)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._kept.update((initialState["records"],))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = self._kept.get()
        known = {r["id"]: r for r in json.loads(kept[0])} if kept else {}
        came, changed = {}, []
        for r in rows:
            record = json.loads(r["record"])
            came.setdefault(record["model_uuid"], []).append(record)
        for name, records in came.items():
            after = self._merged(known.get(name), records)
            if after is not None:
                known[name] = after
                changed.append(json.dumps(after))
        if changed:
            self._kept.update((json.dumps(list(known.values())),))
            yield from map(Row(*CHANGED.fieldNames()), changed)

    def _merged(self, before: dict | None, records: list[dict]) -> dict | None:
        """The record after what came, None if that changes nothing: sessions in order of their names; of rows in a session the later save, as in batches."""
        state, has, changed = None, {}, False
        if before is not None:
            state = {k: v for k, v in before.items() if k != "vector"}
            has = before["vector"]
        later = lambda r: [(x is not None, x) for x in (r["last_saved_counter"], r["last_saved_instance"], r["serialized"], r["deleted"], r["hard_deleted"])]
        for _, same in groupby(sorted(records, key=lambda r: (r["transfer_session_id"], later(r))), key=lambda r: r["transfer_session_id"]):
            same = list(same)
            theirs, got = same[-1], {}
            for entry in (e for r in same for e in r["entries"] or []):
                got[entry["instance_id"]] = max(entry["counter"], got.get(entry["instance_id"], entry["counter"]))
            kind = kind_of(state, has, theirs, got)
            if kind != REVERSE_FF:
                state, has = merged(state, has, theirs, got, kind, self.instance_id, self.counter)
                changed = True
        return state | {"vector": has} if changed else None

    def close(self) -> None:
        pass


def kept_groups(store: DataFrame, rmc: DataFrame) -> DataFrame:
    """(group, records): the state that a stream starts from."""
    every = store.select(*STORE.fieldNames()).join(vector_maps(rmc, "id", "vector"), "id", "left")
    whole = every.withColumn("vector", F.coalesce("vector", F.expr("cast(map() as map<string, int>)")))
    texts = whole.select(group_of("id"), F.to_json(F.struct(*_RECORD.fieldNames()), _WHOLE).alias("record"))
    return texts.groupBy("group").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("record")), F.lit("]")).alias("records"))


def merge_by_state(wire: DataFrame, snapshots: Snapshots, checkpoint: str, instance_id: str, counter: int, filters: Filter, profile: str, **trigger: Any) -> StreamingQuery:
    """Merge a stream of wire records, records' rows and vectors kept as state, by groups of ids; changes become snapshot versions.

    A batch reads neither the store nor its vectors, so it costs what came, not what
    there is. The state starts from the latest snapshot, once, and the stream then is
    the only one to write the store: a replica that captures rows of its own merges
    by batches (streaming.ingest), which read what others wrote. ``counter`` is the
    instance's, raised once for this stream. Records that can't be taken are left out.
    """
    spark = snapshots.spark
    _with_rocksdb(spark)
    rows = exchange.judged(wire.where("transfer_session_id is not null"), F.col("transfer_session_id"), filters, profile).where("problem is null")
    rows = rows.select(group_of("model_uuid"), F.to_json(F.struct("transfer_session_id", "model_uuid", *RECORD_COLUMNS, F.col("rmcb_list").alias("entries")), _WHOLE).alias("record"))
    start = kept_groups(snapshots.read("store"), snapshots.read("rmc"))
    changed = rows.groupBy("group").transformWithState(Merging(instance_id, counter), CHANGED, "Update", "None", start.groupBy("group"))

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            if batch.count():  # all partitions at once, which isEmpty would take one after another
                whole = batch.select(F.from_json("record", _RECORD).alias("r"))
                entries = whole.select("r.id", F.explode("r.vector").alias("instance_id", "counter"))
                snapshots.retried(lambda base: snapshots.commit({}, {"store": (whole.select(*[f"r.{c}" for c in STORE.fieldNames()]), ["id"]), "rmc": (entries, ["id"])}, after=base))
                snapshots.compact()
        finally:
            batch.unpersist()

    held = sum(p["bytes"] for t in ("store", "rmc") for p in snapshots.manifest()[t]["parts"])
    writer = changed.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return started(writer, spark, max(spark.sparkContext.defaultParallelism, -(-held // PARTITION_BYTES)))


#: What sessions report: a sync session (no transfer), or one of its transfers; both say whether they are active.
ACTIVITY = T.StructType([T.StructField(n, k) for n, k in (("sync_session_id", T.StringType()), ("transfer_id", T.StringType()), ("active", T.BooleanType()), ("filter", T.StringType()), ("at", T.TimestampType()))])
EXPIRED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("id", T.StringType())])
_SESSION = "sessions string"


class Expiring(StatefulProcessor):
    """Keeps the last activity of a sync session and its transfers, and tells which were silent for too long."""

    def __init__(self, hours: float, prefix: str):
        self.silence, self.prefix = int(timedelta(hours=hours).total_seconds() * 1000), prefix

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._kept = handle, handle.getValueState("sessions", _SESSION)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """A later report replaces an earlier one; one of that moment counts if it came last."""
        known = self._load()
        for r in rows:
            name, at = r["transfer_id"] or "", int(r["at"].timestamp() * 1000)
            if name not in known or known[name][0] <= at:
                known[name] = [at, bool(r["active"]), r["filter"] or ""]
        return self._expire(key, known, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._expire(key, self._load(), timerValues)

    def _load(self) -> dict[str, list]:
        return json.loads(self._kept.get()[0]) if self._kept.exists() else {}

    def _expire(self, key: Any, known: dict[str, list], timerValues: Any) -> Iterator[Row]:
        """Transfers that may expire go first; the session goes if it was silent too and has no other that is active."""
        now = timerValues.getCurrentWatermarkInMs()
        silent = lambda name: known[name][1] and known[name][0] + self.silence < now
        out = []
        if known.get("", [0, False])[1]:
            for name in sorted(n for n in known if n and silent(n) and known[n][2].startswith(self.prefix)):
                known[name][1] = False
                out.append(Row("kind", "id")("transfer", name))
            if silent("") and not any(active for name, (_, active, _) in known.items() if name):
                known[""][1] = False
                out.append(Row("kind", "id")("sync", key[0]))
        self._kept.update((json.dumps(known, sort_keys=True),))
        ahead = [at + self.silence + 1 for at, active, _ in known.values() if active and at + self.silence >= now]
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if ahead:
            self._handle.registerTimer(min(ahead))
        yield from out

    def close(self) -> None:
        pass


def expiring(activity: DataFrame, hours: float = STALE_HOURS, prefix: str = "", late: str = "0 seconds") -> DataFrame:
    """(kind, id) of transfers and sync sessions without activity for so many hours of event time, each once.

    ``activity`` is a stream (see ACTIVITY). Time is what the stream's rows say, so
    somebody has to report now and then: a row with a null session only moves time.
    Of a session's reports only the last of each transfer is kept, and a timer for
    the next that can expire. ``prefix`` narrows transfers by their filter; a sync
    session with another active transfer stays. Reports later than ``late`` behind
    the latest are dropped.
    """
    _with_rocksdb(activity.sparkSession)
    timed = activity.withWatermark("at", late)
    return timed.groupBy("sync_session_id").transformWithState(Expiring(hours, prefix), EXPIRED, "Append", "EventTime", None, "")


def tick(spark: SparkSession, now: datetime) -> DataFrame:
    """A report that only moves time."""
    return spark.createDataFrame([(None, None, False, None)], "sync_session_id string, transfer_id string, active boolean, filter string").withColumn("at", F.lit(str(now)).cast("timestamp"))
