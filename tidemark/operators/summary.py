"""How many records each instance has in each partition, kept up to date instead of counted anew.

A transfer's vectors need to know which partitions and instances any record has
(vectors.reachable). Counted from the store and its vectors that is two whole scans
for each transfer; kept, it is a small table that each merge or capture changes by
the records that it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a count is of: records that the instance saved last, and records whose vector names it.
SAVED, SEEN = "saved", "seen"
KEY = ["kind", "partition", "instance_id"]
SUMMARY = "kind string, partition string, instance_id string, records long"


def counted(store: DataFrame, rmc: DataFrame) -> DataFrame:
    """(kind, partition, instance_id, records) of a whole store and its vectors."""
    return _each(store, rmc).groupBy(*KEY).agg(F.count("*").alias("records"))


def _each(store: DataFrame, rmc: DataFrame) -> DataFrame:
    """A row for each record's last save, and for each entry of its vector."""
    saved = store.select(F.lit(SAVED).alias("kind"), "partition", F.col("last_saved_instance").alias("instance_id"))
    seen = rmc.select("id", "instance_id").distinct().join(store.select("id", "partition"), "id").select(F.lit(SEEN).alias("kind"), "partition", "instance_id")
    return saved.unionByName(seen)


def difference(store: DataFrame, rmc: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """What changes as ``rows`` and ``entries`` take the place of what ``store`` and ``rmc`` have of their ids.

    Store and vectors are cut to these ids, so it costs what changed, and a scan for it.
    """
    ids = rows.select("id").distinct()
    before = _each(store.join(ids, "id", "left_semi"), rmc.join(ids, "id", "left_semi")).withColumn("records", F.lit(-1))
    after = _each(rows, entries).withColumn("records", F.lit(1))
    return before.unionByName(after).groupBy(*KEY).agg(F.sum("records").alias("records")).where("records <> 0")


def applied(summary: DataFrame, change: DataFrame) -> DataFrame:
    """The summary after a difference; what no record has any more is gone."""
    return summary.select(*KEY, "records").unionByName(change.select(*KEY, "records")).groupBy(*KEY).agg(F.sum("records").alias("records")).where("records > 0")


def pairs(summary: DataFrame, producer: bool) -> DataFrame:
    """(partition, instance_id) for vectors.wire_vector: of a producer who saved last, of a receiver whom any record has seen."""
    return summary.where(F.col("kind") == (SAVED if producer else SEEN)).where("records > 0").select("partition", "instance_id")
