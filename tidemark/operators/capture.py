"""Capture: changed application rows into the store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payload
from ..functions.identity import PLACEHOLDER, placed, record_id
from ..functions.scope import any_prefix
from ..schemas import DIRTY, PARTITION, SOURCE, STORE


@dataclass(frozen=True)
class ForeignKey:
    column: str
    model: str
    nullable: bool = True


@dataclass(frozen=True)
class Model:
    """An application table that is replicated.

    ``source_id`` and ``partition`` give a row's natural id and place as columns
    (the place may hold the placeholder for the row's own id); ``own_id`` replaces
    the hashed id where a model has one of its own.
    """

    name: str
    schema: T.StructType
    foreign_keys: tuple[ForeignKey, ...] = ()
    source_id: Column | None = None
    partition: Column | None = None
    own_id: Column | None = None
    skipped: frozenset[str] = frozenset()
    as_text: frozenset[str] = frozenset()
    depends_on: tuple[str, ...] = ()
    checks: tuple[tuple[str, Column, str], ...] = ()
    defaults: dict[str, Column] = field(default_factory=dict)
    #: Columns of the store's and the other side's text to the text that a conflict keeps; None keeps the store's.
    resolve_conflict: Callable[[Column, Column], Column] | None = None

    @property
    def self_key(self) -> str | None:
        own = [k.column for k in self.foreign_keys if k.model == self.name]
        if len(own) > 1:
            raise ValueError(f"{self.name} refers to itself by more than one column")
        return own[0] if own else None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.schema.fieldNames() if c not in self.skipped]


class Registry:
    """Models by profile and name, and what each profile's application says of itself to others (``info``)."""

    def __init__(self, info: dict[str, dict[str, str]] | None = None, /, **profiles: list[Model]):
        self._profiles = {name: {m.name: m for m in in_order(models)} for name, models in profiles.items()}
        self._info = info or {}

    def instance_info(self, profile: str) -> dict[str, str]:
        """What a replica of the profile tells its peers beside its id; nothing if the profile says nothing."""
        return dict(self._info.get(profile, {}))

    def model(self, profile: str, name: str) -> Model:
        return self._profiles[profile][name]

    def models(self, profile: str) -> list[Model]:
        """All models of a profile, those that others refer to first; none for an unknown profile."""
        return list(self._profiles.get(profile, {}).values())


def saved(rows: DataFrame, table: DataFrame, dirty: bool | None = True) -> DataFrame:
    """Rows with the dirty bit that a save gives them: set, cleared, or (None) left as the table has it, set for new rows."""
    if dirty is not None:
        return rows.withColumn(DIRTY, F.lit(dirty))
    had = table.select("id", F.col(DIRTY).alias("__had"))
    return rows.drop(DIRTY).join(had, "id", "left").withColumn(DIRTY, F.coalesce("__had", F.lit(True))).drop("__had")


def updated(table: DataFrame, which: Column, changes: dict[str, Column], dirty: bool | None = True) -> DataFrame:
    """A bulk update of the rows that ``which`` holds for; the dirty bit as in ``saved``."""
    marks = changes if dirty is None else changes | {DIRTY: F.lit(dirty)}
    return table.select(*[F.when(which, marks[c]).otherwise(F.col(c)).alias(c) if c in marks else F.col(c) for c in table.columns])


def in_order(models: list[Model]) -> list[Model]:
    """Models with those that they refer to or depend on before them."""
    from graphlib import TopologicalSorter

    by_name = {m.name: m for m in models}
    needs = {m.name: {k.model for k in m.foreign_keys} - {m.name} | set(m.depends_on) for m in models}
    return [by_name[n] for n in TopologicalSorter(needs).static_order() if n in by_name]


def identified(rows: DataFrame, model: Model) -> DataFrame:
    """Rows with id, source id and partition filled in where the id is still null."""
    source = F.coalesce(model.source_id.cast("string") if model.source_id is not None else F.lit(None).cast("string"), F.replace(F.uuid(), F.lit("-")))
    rows = rows.withColumn(SOURCE, F.coalesce(F.col(SOURCE), source))
    template = model.partition if model.partition is not None else F.coalesce(F.col(PARTITION), F.lit(""))
    own = model.own_id if model.own_id is not None else record_id(template, F.col(SOURCE), F.lit(model.name))
    rows = rows.withColumn("__template", template).withColumn("id", F.coalesce("id", own))
    return rows.withColumn(PARTITION, F.coalesce(F.col(PARTITION), placed(F.col("__template"), F.col("id")))).drop("__template")


def captured(app: DataFrame, model: Model, store: DataFrame, profile: str, instance_id: str, counter: int, filters: list[str] | None = None) -> DataFrame:
    """Store rows of the model's dirty application rows, as they are after the capture.

    A row that the store has keeps its place and identity; its text is merged key
    by key. If the store's row is dirty itself its text is put aside as a
    conflict. All rows of a capture have one counter.
    """
    dirty = app.where(F.col(DIRTY))
    if filters:
        dirty = dirty.where(any_prefix(PARTITION, filters))
    self_ref = F.coalesce(F.col(model.self_key).cast("string"), F.lit("")) if model.self_key else F.lit("")
    new = dirty.select("id", F.col(PARTITION).alias("__partition"), F.col(SOURCE).alias("__source"), self_ref.alias("__self"), payload.payload(model.columns, model.as_text).alias("__text"))
    known = store.where(F.col("profile") == profile).join(new.select("id"), "id", "left_semi")  # few, so the store itself isn't shuffled
    both = new.join(known.select("id", F.struct("*").alias("s")), "id", "left")
    old = lambda c, otherwise: F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(otherwise)
    aside = F.when(F.col("s.dirty_bit"), F.concat("s.serialized", F.lit("\n"), "s.conflicting_serialized_data"))
    columns = {
        "profile": F.lit(profile), "model_name": F.lit(model.name), "partition": old("partition", F.col("__partition")), "source_id": old("source_id", F.col("__source")),
        "serialized": old("serialized", F.col("__text")), "deleted": F.lit(False), "hard_deleted": F.lit(False), "last_saved_instance": F.lit(instance_id),
        "last_saved_counter": F.lit(counter).cast("int"), "conflicting_serialized_data": F.coalesce(aside, F.col("s.conflicting_serialized_data"), F.lit("")),
        "self_ref_fk": old("self_ref_fk", F.col("__self")), "dirty_bit": F.lit(False), "deserialization_error": F.coalesce("s.deserialization_error", F.lit("")),
        "last_transfer_session_id": F.lit(None).cast("string"),
    }
    columns["serialized"] = F.when(F.col("s").isNull(), F.col("__text")).otherwise(payload.merged(F.col("s.serialized"), F.col("__text")))
    return both.select("id", *[c.alias(n) for n, c in columns.items()]).select(*STORE.fieldNames())


def split(rows: DataFrame, store: DataFrame) -> DataFrame:
    """(id, is_new) of rows to be saved: whether the store has to insert or update them."""
    return rows.join(store.select("id", F.lit(True).alias("__known")), "id", "left").select("id", F.col("__known").isNull().alias("is_new"))


def replaced(table: DataFrame, new: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Full-row upsert: rows of ``new`` in place of those with the same key."""
    keys = [key] if isinstance(key, str) else key
    return table.join(new.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(new)


def patched(table: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Partial upsert: the columns of rows with the key take the new values, nulls included; other rows stay."""
    marks = changes.select(key, F.struct(*columns).alias("__new"))
    out = table.join(marks, key, "left")
    return out.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def touched(rmc: DataFrame, ids: DataFrame, instance_id: str, counter: int) -> DataFrame:
    """Record vectors with (instance, counter) for each id."""
    new = ids.select("id", F.lit(instance_id).alias("instance_id"), F.lit(counter).cast("int").alias("counter"))
    return replaced(rmc, new, ["id", "instance_id"])


def soft_deleted(store: DataFrame, deleted: DataFrame, profile: str, instance_id: str, counter: int) -> DataFrame:
    """Store after the tracked deletions of the profile: marked deleted, clean, saved now. No filter applies."""
    ids = deleted.where(F.col("profile") == profile).select("id").distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull() & (F.col("profile") == profile)
    out = store.join(ids, "id", "left")
    changes = {"deleted": F.lit(True), "dirty_bit": F.lit(False), "last_saved_instance": F.lit(instance_id), "last_saved_counter": F.lit(counter).cast("int")}
    return out.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in store.columns])


def hard_deleted(store: DataFrame, deleted: DataFrame, profile: str) -> DataFrame:
    """Store after the tracked hard deletions of the profile: marked, and their texts emptied."""
    ids = deleted.where(F.col("profile") == profile).select("id").distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull() & (F.col("profile") == profile)
    changes = {"hard_deleted": F.lit(True), "serialized": F.lit("{}"), "conflicting_serialized_data": F.lit("")}
    return store.join(ids, "id", "left").select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in store.columns])


def own_counters(dmc: DataFrame, filters: list[str] | None, instance_id: str, counter: int) -> DataFrame:
    """Database vector with the capture's counter for each filter, or for everything."""
    spark = dmc.sparkSession
    new = spark.createDataFrame([(f, instance_id, counter) for f in filters or [""]], "partition string, instance_id string, counter int")
    return replaced(dmc, new, ["partition", "instance_id"])


@dataclass
class Captured:
    store: DataFrame
    rmc: DataFrame
    dmc: DataFrame
    apps: dict[str, DataFrame]


def capture(apps: dict[str, DataFrame], models: list[Model], store: DataFrame, rmc: DataFrame, dmc: DataFrame, deleted: DataFrame, erased: DataFrame, profile: str, instance_id: str, counter: int, filters: list[str] | None = None) -> Captured:
    """All models' changes, then soft and hard deletions, then the own counters.

    ``deleted`` and ``erased`` are the tracked deletions, done with afterwards.
    """
    clean = {}
    changes = None
    for model in in_order(models):
        app = identified(apps[model.name], model)
        rows = captured(app, model, store, profile, instance_id, counter, filters)
        changes = rows if changes is None else changes.unionByName(rows)
        done = F.col(DIRTY) & any_prefix(PARTITION, filters) if filters else F.col(DIRTY)
        clean[model.name] = app.withColumn(DIRTY, F.when(done, False).otherwise(F.col(DIRTY)))
    out = replaced(store, changes) if changes is not None else store
    gone = out.join(deleted.where(F.col("profile") == profile).select("id").distinct(), "id", "left_semi").select("id")
    saved = changes.select("id").union(gone).distinct() if changes is not None else gone
    out = hard_deleted(soft_deleted(out, deleted, profile, instance_id, counter), erased, profile)
    return Captured(out, touched(rmc, saved, instance_id, counter), own_counters(dmc, filters, instance_id, counter), clean)


__all__ = ["PLACEHOLDER", "Captured", "ForeignKey", "Model", "Registry", "capture", "captured", "hard_deleted", "identified", "in_order", "own_counters", "patched", "replaced", "saved", "soft_deleted", "touched", "updated"]
