"""Merging transfers as they arrive, with Structured Streaming.

Order and lateness need no watermark: a late record is dropped or becomes a
conflict by its version vector. What a transfer promises (its vector) counts
only once all its records have been merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scope import Filter
from ..operators import exchange, merge, progress, summary
from ..operators.capture import Model
from ..operators.trees import cut
from ..schemas import DMC
from ..sources.pages import read_vectors, stream_pages
from ..sources.snapshots import Snapshots

_SEEN = ["transfer_session_id", "model_uuid"]


def merge_batch(
    snapshots: Snapshots, wire: DataFrame, instance_id: str, filters: Filter, profile: str, clock: Callable[[], int],
    vectors: DataFrame | None = None, models: list[Model] = (), batch: str | None = None,
) -> list[str]:
    """Merge the records of one micro-batch, session by session in order of their names; returns the sessions.

    All sessions are folded at once (merge.fold_gathered). The whole batch is one commit, and
    only of what it changes: rows of the store and vectors of the records that came,
    not the tables; a commit of someone else meanwhile has it merged again into what
    that one left. The batch's number is no part of the result: a batch that is run
    again finds its records in the store's vectors and drops them, so replays change
    nothing but the clock. ``models`` may have rules for conflicts.

    ``vectors`` (see sources.pages.read_vectors) tells what transfers bring. When
    as many different records of a transfer have come as it has, its vector is taken
    into the database vector, so that the next transfer needn't send them again.
    ``batch`` names the batch, for the counts of records that came.
    """
    session = F.col("transfer_session_id")
    wire = wire.where(session.isNotNull())
    names = [r[0] for r in wire.select("transfer_session_id").distinct().orderBy("transfer_session_id").collect()]
    if not names:
        return []
    counters = [(name, clock()) for name in names]
    rows = exchange.judged(wire, session, filters, profile)
    refused, rows = rows.where("problem is not null").select(*_SEEN, "problem"), rows.where("problem is null")
    place = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])[session]
    ids = cut(rows.groupBy(F.col("model_uuid").alias("id")).agg(F.count("*").alias("n"), F.max(place).alias("place")))
    most = ids.agg(F.max("n")).first()[0] or 0
    if most <= 1:  # no record came twice
        each, received = merge.gathered(rows, names, once=True), ids.select(F.get(F.array(*map(F.lit, names)), "place").alias(_SEEN[0]), F.col("id").alias(_SEEN[1]))
    else:
        each = cut(merge.gathered(rows, names))
        received = each.select(F.explode("each.b.transfer_session_id").alias(_SEEN[0]), F.col("id").alias(_SEEN[1]))
    ids = ids.select("id")
    arrived = cut(received.groupBy("transfer_session_id").agg(F.count("*").alias("n")).select("transfer_session_id", F.lit(batch or uuid.uuid4().hex).alias("batch"), "n"))

    def once(base: int) -> list[str]:
        store, rmc = (snapshots.read(t, base, ids) for t in ("store", "rmc"))
        rows, entries = merge.rows_of(cut(merge.fold_gathered(store, each, rmc, instance_id, counters, most, merge.rule_of(list(models)))))
        changed = {"store": (rows, ["id"]), "rmc": (entries, ["id"]), "refused": (refused, [*_SEEN, "problem"]), "received": (received, _SEEN), "arrived": (arrived, ["transfer_session_id", "batch"])}
        if "summary" in snapshots.tables(base):
            changed["summary"] = (_recounted(snapshots, base, summary.difference(store, rmc, rows, entries)), summary.KEY)
        tables = _completed(snapshots, base, changed, vectors, names) if vectors is not None else {}
        snapshots.commit(tables, {t: c for t, c in changed.items() if t not in tables}, after=base)
        return names

    return snapshots.retried(once)


def _recounted(snapshots: Snapshots, base: int, change: DataFrame) -> DataFrame:
    """New counts of the partitions and instances that a batch changes; 0 where nothing is left."""
    change = cut(change)
    known = snapshots.read("summary", base, change.select(*summary.KEY))
    return change.join(known.withColumnRenamed("records", "before"), summary.KEY, "left").select(*summary.KEY, (F.coalesce("before", F.lit(0)) + F.col("records")).alias("records"))


def _completed(snapshots: Snapshots, base: int, changed: dict, vectors: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """Tables that change because transfers are complete.

    Counts by batch say cheaply when that may be so; only then the ids that came are
    counted for themselves, as a record may come twice.
    """
    mine = F.col("transfer_session_id").isin(names)
    held = set(snapshots.tables(base))

    def seen(table: str) -> DataFrame:
        rows, key = changed[table]
        return snapshots.read(table, base).join(rows.select(*key), key, "left_anti").select(*rows.columns).unionByName(rows) if table in held else rows

    told = vectors.select("transfer_session_id", "records").distinct()
    counted = seen("arrived").where(mine).groupBy("transfer_session_id").agg(F.sum("n").alias("n"))
    maybe = [r[0] for r in counted.join(told, "transfer_session_id").where("n >= records").select("transfer_session_id").distinct().collect()]
    if not maybe:
        return {}
    exact = seen("received").where(F.col("transfer_session_id").isin(maybe)).groupBy("transfer_session_id").agg(F.countDistinct("model_uuid").alias("n"))
    due = [r[0] for r in exact.join(told, "transfer_session_id").where("n >= records").select("transfer_session_id").distinct().collect()]
    if not due:
        return {}
    over = F.col("transfer_session_id").isin(due)
    dmc = snapshots.read("dmc", base) if "dmc" in held else snapshots.spark.createDataFrame([], DMC)
    brought = vectors.where(over & F.col("side").isNotNull()).groupBy("side", "partition", "instance_id").agg(F.max("counter").alias("counter"))
    return {"dmc": merge.dmc_with_parts(dmc, brought), "received": seen("received").where(~over), "arrived": seen("arrived").where(~over)}


def merge_stream(spark: SparkSession, folder: str, snapshots: Snapshots, checkpoint: str, instance_id: str, filters: Filter, profile: str, clock: Callable[[], int], vector_folder: str | None = None, models: list[Model] = (), **trigger) -> StreamingQuery:
    """Start merging what arrives in an exchange folder; each micro-batch becomes a snapshot version.

    ``vector_folder`` is where senders say what their transfers bring; they write
    there before they write pages. ``models`` may have rules for conflicts. Records and
    bytes of each batch are in the stream's progress (see operators.progress).
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            merge_batch(snapshots, batch, instance_id, filters, profile, clock, read_vectors(spark, vector_folder) if vector_folder else None, models, str(number))
            snapshots.compact()
        finally:
            batch.unpersist()

    return progress.watched(stream_pages(spark, folder)).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
