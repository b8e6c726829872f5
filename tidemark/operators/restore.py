"""Restore: dirty store rows into application tables, with validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import payload
from ..functions.scope import any_prefix
from ..schemas import DIRTY, PARTITION, SOURCE
from .capture import Model, in_order, patched, replaced
from .trees import COMPACT_ROUNDS, cascade, cut, reach, written

PARENT_DIRTY = "waits for its parent, which is not restored"
PARENT_MISSING = "has a parent that the store lacks"


def references(rows: DataFrame, model: Model, to_itself: bool = False) -> DataFrame:
    """(from_id, column, to_model, to_id) of all foreign keys that are set; those of the model to itself only if asked."""
    keys = [k for k in model.foreign_keys if to_itself or k.model != model.name]
    if not keys:
        return rows.sparkSession.createDataFrame([], "from_id string, column string, to_model string, to_id string")
    each = F.array(*[F.struct(F.lit(k.column).alias("column"), F.lit(k.model).alias("to_model"), F.col(f"row.{k.column}").cast("string").alias("to_id")) for k in keys])
    return rows.select(F.col("id").alias("from_id"), F.explode(each).alias("k")).select("from_id", "k.*").where("to_id is not null and to_id <> ''")


def missing(refs: DataFrame, store: DataFrame) -> DataFrame:
    """References whose target the store hasn't, whatever application tables hold."""
    return refs.join(store.select(F.col("id").alias("to_id")), "to_id", "left_anti")


def to_deleted(refs: DataFrame, store: DataFrame) -> DataFrame:
    """References to a target that is deleted or erased; ``hard`` tells which."""
    gone = store.where("deleted or hard_deleted").select(F.col("id").alias("to_id"), F.col("hard_deleted").alias("hard"))
    return refs.join(gone, "to_id")


def _reasons(bad: DataFrame) -> DataFrame:
    """(from_id, why): JSON of column to message."""
    each = F.struct(F.col("column").alias("name"), missing_text(F.col("to_model"), F.col("to_id")).alias("message"))
    return bad.groupBy("from_id").agg(payload.messages(F.array_sort(F.collect_set(each))).alias("why"))


def missing_text(model: Column, pk: Column) -> Column:
    return F.concat(F.lit("no "), model, F.lit(" has the id "), pk)


def checks(model: Model) -> list[tuple[str, Column, str]]:
    """(field, condition that fails, message) for the parsed struct ``row``: nulls, lengths, then the model's own."""
    out = []
    for f in model.schema:
        if f.name in model.skipped:
            continue
        if not f.nullable:
            out.append((f.name, F.col(f"row.{f.name}").isNull(), "This field cannot be null."))
        if isinstance(f.dataType, T.StringType):
            if f.metadata.get("max_length"):
                out.append((f.name, F.length(f"row.{f.name}") > f.metadata["max_length"], f"Ensure this value has at most {f.metadata['max_length']} characters."))
            if f.metadata.get("not_blank"):
                out.append((f.name, F.col(f"row.{f.name}") == "", "This field cannot be blank."))
            if f.metadata.get("uuid"):
                out.append((f.name, ~F.replace(F.col(f"row.{f.name}"), F.lit("-")).rlike("^[0-9a-fA-F]{32}$"), "is not a valid UUID."))
    out += [(k.column, F.coalesce(F.col(f"row.{k.column}"), F.lit("")) == "", "This field cannot be null.") for k in model.foreign_keys if not k.nullable]
    return out + list(model.checks)


def field_errors(model: Model) -> Column:
    """JSON of field to message; null if the row is valid. A payload that isn't JSON fails as a whole."""
    found = [F.when(bad, F.struct(F.lit(name).alias("name"), F.lit(text).alias("message"))) for name, bad, text in checks(model)]
    unreadable = F.when(F.expr("try_parse_json(serialized)").isNull(), F.struct(F.lit("serialized").alias("name"), F.lit("Payload is not JSON.").alias("message")))
    every = F.array_compact(F.array(unreadable, *found))
    return F.when(F.size(every) > 0, payload.messages(F.array_distinct(every)))


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """Store rows with ``row`` (the typed record) and ``error``."""
    parsed = rows.withColumn("row", payload.parsed(F.col("serialized"), model.schema, model.defaults or None))
    return parsed.withColumn("error", field_errors(model))


@dataclass
class Restored:
    store: DataFrame
    apps: dict[str, DataFrame]
    deleted: DataFrame
    erased: DataFrame
    excluded: DataFrame = field(repr=False, default=None)


def app_rows(good: DataFrame, model: Model) -> DataFrame:
    return good.select(*[F.col("id").alias("id") if c == "id" else F.col(f"row.{c}").alias(c) for c in model.schema.fieldNames()], F.lit(False).alias(DIRTY), F.col("source_id").alias(SOURCE), F.col("partition").alias(PARTITION))


def restore_model(app: DataFrame, model: Model, store: DataFrame, profile: str, excluded: DataFrame, skip_erroring: bool = False, filters: list[str] | None = None, targets: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(app, marks, excluded, gone) after one model's dirty store rows were restored.

    ``marks`` (id, dirty_bit, deserialization_error) are changes of the store;
    ``gone`` (id, hard) are records to be deleted by the next capture, because
    they refer to deleted ones. A model that refers to itself needs ``targets``, the
    application rows (id) of other models that it refers to, as they are by now.
    """
    own = store.where((F.col("profile") == profile) & (F.col("model_name").isin(model.name, *model.depends_on)))
    if filters:
        own = own.where(any_prefix("partition", filters))
    if skip_erroring:
        own = own.where("deserialization_error = ''")
    own = cut(own)
    dirty = own.where("dirty_bit")
    if model.self_key:
        return _restore_levels(app, model, own, excluded, targets or {})
    alive = cut(parse(dirty.where("not deleted and not hard_deleted"), model))
    refs = references(alive.where("error is null"), model)
    out_of = refs.join(excluded.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    bad = _reasons(missing(refs, store).unionByName(out_of))
    gone = to_deleted(refs, store).groupBy("from_id").agg(F.max("hard").alias("hard"))
    judged = alive.join(bad.withColumnRenamed("from_id", "id"), "id", "left").join(gone.withColumnRenamed("from_id", "id"), "id", "left")
    judged = cut(judged.withColumn("error", F.coalesce("error", "why")).drop("why"))
    good = judged.where("error is null and hard is null")
    app = replaced(app, app_rows(good, model).select(*app.columns))
    failed = judged.where("error is not null").select("id", "error")
    error = dirty.select("id", "deserialization_error").join(failed, "id", "left")
    marks = error.select("id", F.col("error").isNotNull().alias("dirty_bit"), F.coalesce("error", "deserialization_error").alias("deserialization_error"))
    return app, marks, excluded.select("id").union(failed.select("id")), judged.where("error is null and hard is not null").select("id", "hard")


def _restore_levels(app: DataFrame, model: Model, own: DataFrame, excluded: DataFrame, targets: dict[str, DataFrame]):
    """A table that refers to itself, downwards from rows whose parent is clean or that have none.

    References, also those to other models, have to name application rows: a target
    that failed or is deleted has none. A deleted row is done with, but whoever
    refers to it fails.
    """
    rows = parse(own.where("dirty_bit"), model).withColumn("gone", F.col("deleted") | F.col("hard_deleted"))
    refs = references(rows.where("error is null and not gone"), model)
    bad = None
    for name in dict.fromkeys(k.model for k in model.foreign_keys if k.model != model.name):
        named = refs.where(F.col("to_model") == name)
        lost = named.join(targets[name].select(F.col("id").alias("to_id")), "to_id", "left_anti") if name in targets else named
        bad = lost if bad is None else bad.unionByName(lost)
    if bad is not None:
        rows = rows.join(_reasons(bad).withColumnRenamed("from_id", "id"), "id", "left").withColumn("error", F.coalesce("error", "why")).drop("why")
    rows = rows.withColumn("error", F.when(~F.col("gone"), F.col("error"))).withColumn("up", F.nullif(F.col(f"row.{model.self_key}").cast("string"), F.lit("")))
    rows = written(rows.select("id", "self_ref_fk", "source_id", "partition", "row", "gone", "error", "up"))
    present = app.select("id").join(rows.where("gone").select("id"), "id", "left_anti").select(F.col("id").alias("up"), F.lit(True).alias("there"))
    rows = written(rows.join(present, "up", "left").withColumn("there", F.coalesce("there", F.lit(False))))
    clean = own.where("not dirty_bit").select(F.col("id").alias("parent"))
    tops = rows.join(clean, F.col("self_ref_fk") == F.col("parent"), "left_semi").union(rows.where("self_ref_fk = ''"))
    # a payload may name another parent than the store's column does; only then restored rows have to be looked through
    odd = not rows.where("not there and up is not null and up <> self_ref_fk").isEmpty()
    done = _by_levels(rows, tops, model) if odd else _by_links(rows, tops, model)
    restored, failed = done.where("error is null"), done.where("error is not null")
    waiting = rows.join(done.select("id"), "id", "left_anti")
    known = own.select(F.col("id").alias("parent"))
    dirty_left = failed.select("id").union(waiting.select("id")).withColumnRenamed("id", "parent")
    behind = waiting.join(dirty_left, F.col("self_ref_fk") == F.col("parent"), "left_semi").select("id", F.lit(PARENT_DIRTY).alias("e"))
    lost = waiting.join(known, F.col("self_ref_fk") == F.col("parent"), "left_anti").select("id", F.lit(PARENT_MISSING).alias("e"))
    marks = restored.select("id", F.lit(False).alias("dirty_bit"), F.lit("").alias("deserialization_error"))
    left = failed.select("id", F.col("error").alias("e")).union(behind).union(lost)
    marks = marks.union(left.select("id", F.lit(True), "e"))
    app = replaced(app, app_rows(restored.where("not gone"), model).select(*app.columns))
    return app, marks, excluded.select("id").union(failed.select("id")), app.sparkSession.createDataFrame([], "id string, hard boolean")


def _orphans(model: Model, there: Column) -> Column:
    """A row's error: its own, or that its parent isn't there."""
    why = payload.messages(F.array(F.struct(F.lit(model.self_key).alias("name"), missing_text(F.lit(model.name), F.col("up")).alias("message"))))
    return F.when(F.col("error").isNull() & ~F.col("gone") & ~there, why).otherwise(F.col("error"))


def _by_links(rows: DataFrame, tops: DataFrame, model: Model) -> DataFrame:
    """The rows that are judged, with their errors.

    Whether a row fails once its turn comes shows from it and its parent alone: the
    parent has no error then, and is deleted or not. So all rows are judged by one
    join, and those whose turn comes are what the tops reach over rows without error.
    """
    parent = rows.select(F.col("id").alias("parent"), (~F.col("gone")).alias("alive"))
    there = F.col("up").isNull() | F.col("there") | (F.coalesce("alive", F.lit(False)) & (F.col("up") == F.col("self_ref_fk")))
    judged = written(rows.join(parent, F.col("self_ref_fk") == F.col("parent"), "left").withColumn("error", _orphans(model, there)).select(*rows.columns))
    fine = judged.where("error is null").select(F.col("id").alias("parent"))
    links = judged.select(F.col("self_ref_fk").alias("parent"), F.col("id").alias("child")).join(fine, "parent", "left_semi")
    return judged.join(reach(tops.select("id"), links), "id", "left_semi")


def _by_levels(rows: DataFrame, tops: DataFrame, model: Model) -> DataFrame:
    """As ``_by_links`` where payloads name parents of their own, which must be restored on an earlier level. Each level writes its own rows only."""
    level, done, depth = tops.withColumn("alive", F.lit(False)), None, 0
    while True:
        there = F.col("up").isNull() | F.col("there") | (F.col("alive") & (F.col("up") == F.col("self_ref_fk")))
        if done is not None:
            restored = done.where("error is null and not gone").select(F.col("id").alias("up"), F.lit(True).alias("late")).distinct()
            level, there = level.join(restored, "up", "left"), there | F.col("late").isNotNull()
        judged = written(level.withColumn("error", _orphans(model, there)).select(*rows.columns))
        if judged.isEmpty():
            return judged if done is None else done
        done, depth = judged if done is None else done.union(judged), depth + 1
        if depth % COMPACT_ROUNDS == 0:
            done = written(done)
        # a row has one parent in the store, so it comes up once
        parents = judged.where("error is null").select(F.col("id").alias("parent"), (~F.col("gone")).alias("alive"))
        level = rows.join(parents, F.col("self_ref_fk") == F.col("parent")).drop("parent")


def restore(apps: dict[str, DataFrame], models: list[Model], store: DataFrame, profile: str, skip_erroring: bool = False, filters: list[str] | None = None) -> Restored:
    """All models, those that others refer to first.

    Rows that fail keep their dirty bit and get an error; the bulk path leaves an
    older error text of rows that succeed, the level path blanks it.
    """
    spark = store.sparkSession
    excluded, roots, keys = spark.createDataFrame([], "id string"), {}, []
    gone = spark.createDataFrame([], "id string, hard boolean")
    out = {}
    waiting = store.where((F.col("profile") == profile) & F.col("dirty_bit"))
    waiting = {r[0] for r in (waiting.where(any_prefix("partition", filters)) if filters else waiting).select("model_name").distinct().collect()}  # as many as models
    for model in in_order(models):
        keys += [(model.name, k.column, k.model) for k in model.foreign_keys]
        if waiting.isdisjoint({model.name, *model.depends_on}):
            out[model.name] = apps[model.name]
            continue
        own = store.where((F.col("profile") == profile) & (F.col("model_name") == model.name) & F.col("dirty_bit"))
        own = own.where(any_prefix("partition", filters)) if filters else own
        own = own.where("deserialization_error = ''") if skip_erroring else own
        roots[model.name] = cut(own.where("deleted or hard_deleted").select("id"))
        targets = _living(model, roots, out, keys) if model.self_key else None
        app, marks, excluded, lost = restore_model(apps[model.name], model, store, profile, excluded, skip_erroring, filters, targets)
        out[model.name], excluded, gone = cut(app), cut(excluded), cut(gone.union(lost))
        store = cut(patched(store, marks, ["dirty_bit", "deserialization_error"]))
    if any(not r.isEmpty() for r in roots.values()):  # rows of deleted records go, and with them those that refer to them
        for name, ids in cascade(roots, out, keys).items():
            roots[name] = ids
        out |= {name: cut(out[name].join(ids, "id", "left_anti").select(*out[name].columns)) for name, ids in roots.items()}
    track = lambda rows: rows.select("id", F.lit(profile).alias("profile")).distinct()
    return Restored(store, out, track(gone), track(gone.where("hard")), excluded)


def _living(model: Model, roots: dict[str, DataFrame], out: dict[str, DataFrame], keys: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Application rows (id) that other models have by now, without those that this restore deletes."""
    others = {k.model for k in model.foreign_keys} - {model.name}
    own = {name: rows for name, rows in roots.items() if name != model.name}
    gone = cascade(own, out, [k for k in keys if k[0] in out]) if any(not r.isEmpty() for r in own.values()) else {}
    return {n: out[n].select("id").join(gone[n], "id", "left_anti") if n in gone else out[n].select("id") for n in others if n in out}


def invalid_references(refs: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missing, deleted) of a table of references."""
    return missing(refs, store), to_deleted(refs, store)


__all__ = ["PARENT_DIRTY", "PARENT_MISSING", "Restored", "field_errors", "invalid_references", "missing", "parse", "references", "restore", "restore_model", "to_deleted"]
