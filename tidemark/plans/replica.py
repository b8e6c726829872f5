"""A replica, and transfers between two of them, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scope import Filter, Scope
from ..operators import capture, exchange, merge, outgoing, progress, restore, summary, vectors
from ..operators.trees import cut
from ..schemas import BUFFER, DELETED, DIRTY, DMC, IDENTITY, PARTITION, RMC, RMCB, SOURCE, STORE, TRANSFER_VECTORS, TRANSFERS
from ..sources.snapshots import Snapshots

#: Stages of a transfer in order.
STAGES = ("initializing", "serializing", "queuing", "transferring", "dequeuing", "deserializing", "cleanup")
PENDING, STARTED, COMPLETED, ERRORED = "pending", "started", "completed", "errored"


class NotAllowed(ValueError):
    pass


def empty_app(spark: SparkSession, model: capture.Model) -> DataFrame:
    fields = model.schema.fields
    return spark.createDataFrame([], capture.T.StructType([*fields, *[capture.T.StructField(n, t) for n, t in ((DIRTY, capture.T.BooleanType()), (SOURCE, capture.T.StringType()), (PARTITION, capture.T.StringType()))]]))


#: Tables of a replica beside those of its application.
_TABLES = ("store", "rmc", "dmc", "deleted", "erased", "buffer", "rmcb")


@dataclass
class Replica:
    """One side: application tables, store, vectors and a clock.

    Tables are DataFrames; each change gives the next version, cut from its
    lineage by a checkpoint in the shared folder.
    """

    spark: SparkSession
    models: list[capture.Model]
    profile: str
    instance_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    counter: int = 0
    scope: Scope = field(default_factory=Scope)
    #: The snapshot that the tables are of; None if they are of none.
    version: int | None = None

    def __post_init__(self) -> None:
        make = self.spark.createDataFrame
        self.apps = {m.name: empty_app(self.spark, m) for m in self.models}
        self.store, self.rmc, self.dmc = make([], STORE), make([], RMC), make([], DMC)
        self.deleted, self.erased = make([], DELETED), make([], DELETED)
        self.buffer, self.rmcb = make([], BUFFER), make([], RMCB)
        #: Records by partition and instance (see operators.summary); counted when first asked for, then kept.
        self.summary: DataFrame | None = None

    def tick(self) -> int:
        self.counter += 1
        return self.counter

    def upsert(self, model: str, rows: DataFrame, dirty: bool | None = True) -> None:
        """Save application rows; they are dirty until captured, or as ``dirty`` says (see capture.saved).

        Missing bookkeeping columns are filled in.
        """
        spec = next(m for m in self.models if m.name == model)
        for c in (SOURCE, PARTITION):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        rows = capture.saved(cut(capture.identified(rows.withColumn(DIRTY, F.lit(True)), spec)), self.apps[model], dirty).select(*self.apps[model].columns)
        self.apps[model] = cut(capture.replaced(self.apps[model], cut(rows)))

    def delete(self, model: str, ids: DataFrame, erase: bool = False) -> None:
        """Delete application rows; the next capture tells the store."""
        ids = cut(ids.select("id").distinct())
        self.apps[model] = cut(self.apps[model].join(ids, "id", "left_anti").select(*self.apps[model].columns))
        track = ids.select("id", F.lit(self.profile).alias("profile"))
        self.deleted = cut(self.deleted.union(track))
        if erase:
            self.erased = cut(self.erased.union(track))

    def serialize(self, filters: Filter | None = None) -> None:
        """Capture what is dirty; tables without a dirty row are neither read again nor written."""
        names, counter = list(filters) if filters else None, self.tick()
        changed = [m for m in self.models if not self.apps[m.name].where(DIRTY).isEmpty()]
        if not changed and self.deleted.isEmpty() and self.erased.isEmpty():
            self.dmc = cut(capture.own_counters(self.dmc, names, self.instance_id, counter))
            return
        done = capture.capture(self.apps, changed, self.store, self.rmc, self.dmc, self.deleted, self.erased, self.profile, self.instance_id, counter, names)
        before = self.store, self.rmc
        self.store, self.rmc, self.dmc = cut(done.store), cut(done.rmc), cut(done.dmc)
        saved = (F.col("last_saved_instance") == self.instance_id) & (F.col("last_saved_counter") == counter)
        self._count(*before, self.store.where(saved), self.rmc)
        self.apps |= {k: cut(v) for k, v in done.apps.items()}
        empty = self.spark.createDataFrame([], DELETED)
        self.deleted, self.erased = empty, empty

    def deserialize(self, filters: Filter | None = None, skip_erroring: bool = False) -> None:
        done = restore.restore(self.apps, self.models, self.store, self.profile, skip_erroring, list(filters) if filters else None)
        self.store, self.apps = done.store, done.apps
        if not done.deleted.isEmpty():
            self.deleted, self.erased = cut(self.deleted.union(done.deleted)), cut(self.erased.union(done.erased))

    def vector(self, filters: Filter, producer: bool) -> DataFrame:
        """Wire vector of a filter, without entries that no record needs."""
        if self.summary is None:
            self.summary = cut(summary.counted(self.store, self.rmc))
        return cut(vectors.wire_vector(self.dmc, list(filters), summary.pairs(self.summary, producer)))

    def _count(self, store: DataFrame, rmc: DataFrame, rows: DataFrame, rmc_after: DataFrame) -> None:
        """Keep the summary as ``rows`` took the place of records of the store."""
        if self.summary is not None:
            entries = rmc_after.join(rows.select("id"), "id", "left_semi")
            self.summary = cut(summary.applied(self.summary, summary.difference(store, rmc, rows, entries)))

    def dequeue(self, session: str, peer_vector: DataFrame) -> None:
        rows, entries = (cut(x) for x in merge.changes(self.store, self.buffer, self.rmc, self.rmcb, self.instance_id, self.tick(), session, merge.rule_of(self.models)))
        before = self.store, self.rmc
        self.store, self.rmc = cut(capture.replaced(self.store, rows)), cut(capture.replaced(self.rmc, entries))
        self._count(*before, rows, entries)
        self.dmc = cut(merge.dmc_with_parts(self.dmc, peer_vector))

    def save(self, snapshots: Snapshots, transfers: list[Transfer] = ()) -> int:
        """Commit all tables, and transfers that are under way, as the version after the one they are of.

        If someone else has made that version, it raises Conflict: saving over it
        would lose what that one holds. ``updated`` loads and works again then.
        """
        tables = {name: getattr(self, name) for name in _TABLES} | {f"app-{m}": df for m, df in self.apps.items()}
        if self.summary is not None:
            tables["summary"] = self.summary
        tables["identity"] = self.spark.createDataFrame([(self.profile, self.instance_id, self.counter)], IDENTITY)
        tables["transfers"] = self.spark.createDataFrame([t.row() for t in transfers], TRANSFERS)
        known = [rows for t in transfers if (rows := t.vector_rows()) is not None]
        tables["vectors"] = reduce(DataFrame.unionByName, known, self.spark.createDataFrame([], TRANSFER_VECTORS))
        self.version = snapshots.commit(tables, after=self.version)
        return self.version

    @classmethod
    def updated(cls, snapshots: Snapshots, models: list[capture.Model], work: Callable[[Replica], None], scope: Scope | None = None) -> Replica:
        """Load the latest version, ``work`` on it, save; again from the new version if another writer was first."""

        def once(base: int) -> Replica:
            out = cls.load(snapshots, models, scope, base)
            work(out)
            out.save(snapshots)
            return out

        return snapshots.retried(once)

    @classmethod
    def load(cls, snapshots: Snapshots, models: list[capture.Model], scope: Scope | None = None, version: int | None = None) -> Replica:
        """The replica of a version. Tables stay where they are until something changes them."""
        n = version or snapshots.version
        who = snapshots.read("identity", n).first()
        out = cls(snapshots.spark, models, who.profile, who.instance_id, who.counter, scope or Scope(), n)
        for name in _TABLES:
            setattr(out, name, snapshots.read(name, n))
        out.apps = {m.name: snapshots.read(f"app-{m.name}", n) for m in models}
        out.summary = snapshots.read("summary", n) if "summary" in snapshots.tables(n) else None
        return out

    def drop_buffers(self, session: str) -> None:
        other = F.col("transfer_session_id") != session
        self.buffer, self.rmcb = cut(self.buffer.where(other)), cut(self.rmcb.where(other))


@dataclass
class Transfer:
    """A push (client to server) or pull (server to client) of the records under a filter.

    ``run`` goes on from the stage last completed, so a transfer that failed can
    be resumed; ``hooks`` are called around each stage with its name and status.
    ``operations`` may replace or precede a stage's own work: each is called with
    the transfer, and the first to return a true value ends the stage.
    """

    client: Replica
    server: Replica
    filters: Filter
    push: bool
    page: int = exchange.PAGE
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    stage: str = ""
    status: str = PENDING
    records_total: int | None = None
    records_transferred: int = 0
    #: Bytes of what the records carry, of those that went over in this process.
    bytes_transferred: int = 0
    hooks: list[Callable[[str, str], None]] = field(default_factory=list)
    operations: dict[str, list[Callable[[Transfer], bool]]] = field(default_factory=dict)

    @property
    def sender(self) -> Replica:
        return self.client if self.push else self.server

    @property
    def receiver(self) -> Replica:
        return self.server if self.push else self.client

    def row(self) -> tuple:
        """What to keep of a transfer so that it can go on elsewhere (see ``resume``)."""
        return self.id, str(self.filters), self.push, self.page, self.stage, self.status, self.records_total, self.records_transferred

    def vector_rows(self) -> DataFrame | None:
        """The two sides' vectors, a row for each entry and one that says a vector is there; None before they are known."""
        out = None
        for name in (n for n in ("sent", "had") if hasattr(self, n)):
            mark = self.client.spark.createDataFrame([(self.id, name, None, None, None, None)], TRANSFER_VECTORS)
            rows = getattr(self, name).select(F.lit(self.id).alias("transfer_session_id"), F.lit(name).alias("vector"), "side", "partition", "instance_id", "counter").unionByName(mark)
            out = rows if out is None else out.unionByName(rows)
        return out

    @classmethod
    def resume(cls, client: Replica, server: Replica, row, kept: DataFrame | None = None) -> Transfer:
        """A transfer from its row, and the table of vectors saved with it, to ``run`` on from the stage last completed."""
        out = cls(client, server, Filter(row.filter), row.push, row.page, row.id, row.stage, row.status, row.records_total, row.records_transferred)
        mine = None if kept is None else kept.where(F.col("transfer_session_id") == row.id)
        for name in () if mine is None else [r[0] for r in mine.where("side is null").select("vector").collect()]:
            setattr(out, name, mine.where((F.col("vector") == name) & F.col("side").isNotNull()).select("side", "partition", "instance_id", "counter"))
        return out

    def run(self, until: str = STAGES[-1]) -> Transfer:
        done = STAGES.index(self.stage) + (self.status == COMPLETED) if self.stage else 0
        for stage in STAGES[done : STAGES.index(until) + 1]:
            self._mark(stage, STARTED)
            try:
                if not any(f(self) for f in self.operations.get(stage, [])):
                    getattr(self, f"_{stage}")()
            except Exception:
                self._mark(stage, ERRORED)
                raise
            self._mark(stage, COMPLETED)
        return self

    def _mark(self, stage: str, status: str) -> None:
        self.stage, self.status = stage, status
        for hook in self.hooks:
            hook(stage, status)

    def _initializing(self) -> None:
        if not self.client.scope.allows(self.filters, self.server.scope, self.push):
            raise NotAllowed("the filter is outside of what the scopes allow")

    def _serializing(self) -> None:
        self.sender.serialize(self.filters)
        self.sent, self.had = self.sender.vector(self.filters, True), self.receiver.vector(self.filters, False)

    def _queuing(self) -> None:
        s = self.sender
        buffer, rmcb = outgoing.queue_transfer(s.store, s.rmc, self.sent, self.had, self.filters, s.profile, self.id)
        buffer, queued = progress.observed(buffer)
        s.buffer = cut(s.buffer.unionByName(buffer))
        s.rmcb = cut(s.rmcb.unionByName(rmcb))
        self.records_total = queued.get["records"]

    def _transferring(self) -> None:
        """All that is left goes over at once: within a cluster a page is a label, not a round trip."""
        mine = F.col("transfer_session_id") == self.id
        wire, went = progress.observed(exchange.nested(exchange.numbered(self.sender.buffer.where(mine), self.page), self.sender.rmcb.where(mine)).where(F.col("page") >= self.records_transferred // self.page))
        wire = cut(wire)
        self.bytes_transferred += went.get["bytes"]
        buffer, rmcb, _ = exchange.received(wire, self.id, self.filters, self.receiver.profile)
        self.receiver.buffer = cut(self.receiver.buffer.join(buffer.select("transfer_session_id", "model_uuid"), ["transfer_session_id", "model_uuid"], "left_anti").select(*BUFFER.fieldNames()).unionByName(buffer))
        self.receiver.rmcb = cut(self.receiver.rmcb.unionByName(rmcb).distinct())
        self.records_transferred = self.receiver.buffer.where(mine).count()
        if self.records_transferred != self.records_total:
            raise exchange.InvalidTransfer(f"{self.records_transferred} of {self.records_total} records came over")

    def _dequeuing(self) -> None:
        if self.records_transferred:
            self.receiver.dequeue(self.id, self.sent)

    def _deserializing(self) -> None:
        """What the receiver changed meanwhile is captured first, so that it isn't lost under the restored rows."""
        if self.records_transferred:
            self.receiver.serialize(self.filters)
            self.receiver.deserialize(self.filters)

    def _cleanup(self) -> None:
        self.sender.drop_buffers(self.id)
        self.receiver.drop_buffers(self.id)


def push(client: Replica, server: Replica, filters: Filter) -> Transfer:
    return Transfer(client, server, filters, push=True).run()


def pull(client: Replica, server: Replica, filters: Filter) -> Transfer:
    return Transfer(client, server, filters, push=False).run()
