"""Version vectors of a filter: what a replica holds, and what another one lacks.

A vector is a table (partition, instance_id, counter): all records under the
partition that the instance saved are held up to the counter. The wire form has
a side ("sub": under the filter; "super": above it) and keeps partitions without
counters, which say that there is data; here they are rows with a null instance.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scope import any_prefix, is_prefix_of
from .prefix import prefix_join
from .trees import cut

WIRE = "side string, partition string, instance_id string, counter int"
KEYS = ["partition", "instance_id"]
#: Entries that a vector may have in a transfer (a limit of the protocol, which bounds what is broadcast).
ENTRY_LIMIT = 200 * 500
PART_ENTRY_LIMIT = 200 * 499


class LimitExceeded(ValueError):
    pass


def _filter_array(filters: list[str]) -> Column:
    return F.array(*[F.lit(f) for f in filters])


def per_filter(dmc: DataFrame, filters: list[str]) -> DataFrame:
    """(filter, instance_id, counter): the greatest counter over partitions that are prefixes of a filter.

    The filters are a short list, so they are an array and no join is needed.
    """
    over = F.explode(F.filter(_filter_array(filters), lambda f: f.startswith(F.col("partition"))))
    return dmc.select(over.alias("filter"), "instance_id", "counter").groupBy("filter", "instance_id").agg(F.max("counter").alias("counter"))


def flat_vector(dmc: DataFrame, filters: list[str], producer: bool) -> DataFrame:
    """(instance_id, counter). A producer sends all it has of any filter; a receiver doesn't promise
    more than it has of every filter, so the least counter of those instances that all filters have."""
    each = per_filter(dmc, filters).groupBy("instance_id")
    if producer:
        return each.agg(F.max("counter").alias("counter"))
    return each.agg(F.min("counter").alias("counter"), F.count("*").alias("n")).where(F.col("n") == len(set(filters))).drop("n")


def reachable(dmc: DataFrame, records: DataFrame) -> DataFrame:
    """Entries with at least one record (partition, instance_id) under their partition.

    Many records share few (partition, instance) pairs, so these are made
    distinct first; then paths are joined to prefixes by equal keys.
    """
    pairs = records.select(F.col("partition").alias("path"), "instance_id").distinct()
    found = prefix_join(pairs, dmc.select(*KEYS).distinct(), "path", "partition", ("instance_id",)).select(*KEYS).distinct()
    return dmc.join(found, KEYS, "left_semi")


def store_pairs(store: DataFrame) -> DataFrame:
    """For a producer: who saved which partitions last."""
    return store.select("partition", F.col("last_saved_instance").alias("instance_id"))


def vector_pairs(store: DataFrame, rmc: DataFrame) -> DataFrame:
    """For a receiver: all instances that any record has seen."""
    return rmc.join(store.select("id", "partition"), "id").select("partition", "instance_id")


def list_pairs(held: DataFrame) -> DataFrame:
    """As vector_pairs, of store rows that have their vectors with them (``entries``): nothing meets by id."""
    return held.select("partition", F.explode("entries.instance_id").alias("instance_id"))


def wire_vector(dmc: DataFrame, filters: list[str], records: DataFrame | None = None) -> DataFrame:
    """The vector of a filter in wire form, entries that a shorter prefix covers removed.

    ``records`` (see store_pairs, vector_pairs) drops entries that no record
    needs; without it nothing is dropped. A partition can be on both sides if a
    filter is a prefix of another.
    """
    sub = any_prefix("partition", filters)
    above = F.exists(_filter_array(filters), lambda f: f.startswith(F.col("partition")) & (f != F.col("partition")))
    sides = F.explode(F.array_compact(F.array(F.when(sub, F.lit("sub")), F.when(above, F.lit("super")))))
    kept = cut(reachable(dmc, records)) if records is not None else dmc  # few rows of much work, read several times below
    return without_redundant(kept.select(sides.alias("side"), *KEYS, "counter"))


def without_redundant(wire: DataFrame) -> DataFrame:
    """Drop entries for which a strict prefix partition has the same instance at least as far; their partitions stay."""
    entries = wire.where("instance_id is not null")
    high = entries.groupBy(*KEYS).agg(F.max("counter").alias("high")).withColumnRenamed("partition", "prefix")
    covered = prefix_join(entries.select(*KEYS, "counter").distinct(), high, "partition", "prefix", ("instance_id",)).where("partition <> prefix and high >= counter")
    left = entries.join(covered.select(*KEYS, "counter").distinct(), [*KEYS, "counter"], "left_anti")
    empty = wire.select("side", "partition").distinct().join(left.select("side", "partition").distinct(), ["side", "partition"], "left_anti")
    return left.select("side", *KEYS, "counter").unionByName(empty.select("side", "partition", F.lit(None).cast("string").alias("instance_id"), F.lit(None).cast("int").alias("counter")))


def expanded(wire: DataFrame, filters: list[str]) -> DataFrame:
    """Wire form to (partition, instance_id, counter): counters from above are handed down to the topmost partitions."""
    spark = wire.sparkSession
    sub = wire.where("side = 'sub'")
    parts = sub.select("partition").union(spark.createDataFrame([(f,) for f in filters], "partition string")).distinct()
    below = prefix_join(parts.withColumnRenamed("partition", "path"), parts.withColumnRenamed("partition", "prefix"), "path", "prefix").where("path <> prefix")
    tops = parts.join(below.select(F.col("path").alias("partition")).distinct(), "partition", "left_anti")
    above = wire.where("side = 'super' and instance_id is not null").select(F.col("partition").alias("prefix"), "instance_id", "counter")
    handed = prefix_join(tops, above, "partition", "prefix").select(*KEYS, "counter")
    own = sub.where("instance_id is not null").select(*KEYS, "counter")
    return own.unionByName(handed).groupBy(*KEYS).agg(F.max("counter").alias("counter"))


def flat_diff(sender: DataFrame, receiver: DataFrame) -> DataFrame:
    """(instance_id, counter): from where on the receiver lacks what the sender has."""
    other = receiver.select("instance_id", F.col("counter").alias("has"))
    has = F.coalesce("has", F.lit(0))
    return sender.join(other, "instance_id", "left").where(has < F.col("counter")).select("instance_id", has.alias("counter"))


def diff(sender: DataFrame, receiver: DataFrame) -> DataFrame:
    """(partition, instance_id, counter): as flat_diff, the receiver's counter being the greatest over prefixes."""
    other = receiver.select(F.col("partition").alias("prefix"), "instance_id", F.col("counter").alias("has"))
    covered = prefix_join(sender, other, "partition", "prefix", ("instance_id",)).groupBy(*KEYS).agg(F.max("has").alias("has"))
    has = F.coalesce("has", F.lit(0))
    return sender.join(covered, KEYS, "left").where(has < F.col("counter")).select(*KEYS, has.alias("counter"))


def chunks(vector: DataFrame, size: int) -> list[dict[str, dict[str, int]]]:
    """Vector entries in groups of at most ``size`` partitions and instances, in order.

    A partition costs one entry wherever it is opened. A vector beyond the limit
    of a transfer is refused.
    """
    if (n := vector.count()) > ENTRY_LIMIT:
        raise LimitExceeded(f"{n} vector entries are too many for a transfer")
    out: list[dict[str, dict[str, int]]] = []
    room, opened = 0, None
    for part, instance, counter in sorted(tuple(r) for r in vector.select(*KEYS, "counter").collect()):
        cost = 1 if part == opened else 2
        if not out or room < cost:
            out.append({})
            room, cost = size, 2
        out[-1].setdefault(part, {})[instance] = counter
        room, opened = room - cost, part
    return out


def to_json(wire: DataFrame) -> str:
    """Wire form as text, for peers that take one; a text is one value, so all of it is held where it is asked for."""
    out: dict[str, dict] = {"super": {}, "sub": {}}
    for side, part, instance, counter in wire.select("side", *KEYS, "counter").collect():
        entries = out[side].setdefault(part, {})
        if instance is not None:
            entries[instance] = counter
    return json.dumps(out, sort_keys=True)


def from_json(spark: SparkSession, text: str) -> DataFrame:
    rows = []
    for side, parts in json.loads(text).items():
        for part, entries in parts.items():
            rows += [(side, part, i, c) for i, c in entries.items()] or [(side, part, None, None)]
    return spark.createDataFrame(rows, WIRE)
