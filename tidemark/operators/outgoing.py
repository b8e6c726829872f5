"""Queueing: exactly the records that the other side lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scope import Filter
from ..schemas import RECORD_COLUMNS
from . import vectors
from .prefix import prefix_join
from .trees import written
from .vectors import ENTRY_LIMIT, PART_ENTRY_LIMIT, LimitExceeded


class PartitionOutsideFilter(ValueError):
    pass


def outside(wire: DataFrame, filters: Filter) -> DataFrame:
    """(partition): what a vector names as under the filter and isn't."""
    return wire.where("side = 'sub'").where(~filters.column("partition")).select("partition").distinct()


def check_partitions(wire: DataFrame, filters: Filter) -> None:
    """Every partition under the filter that a vector names must be in the filter."""
    bad = outside(wire, filters).first()
    if bad:
        raise PartitionOutsideFilter(f"a vector names {bad[0]!r}, which the filter doesn't cover")


def _within(weight: int, limit: int) -> None:
    if weight >= limit:
        raise LimitExceeded(f"{weight} vector entries and partitions are too many for a transfer (fewer than {limit})")


def queue_flat(store: DataFrame, diff: DataFrame, filters: list[str], profile: str) -> DataFrame:
    """Store rows under the filters whose last save is above the diff's bound for its instance."""
    diff = written(diff)  # counted, then joined
    _within(diff.count(), ENTRY_LIMIT)
    bound = F.broadcast(diff.select(F.col("instance_id").alias("i"), F.col("counter").alias("c")))
    own = store.where(F.col("profile") == profile).where(Filter("\n".join(filters)).column("partition"))
    return own.join(bound, (F.col("last_saved_instance") == F.col("i")) & (F.col("last_saved_counter") > F.col("c")), "left_semi")


def queue(store: DataFrame, diff: DataFrame, profile: str, limit: int | None = PART_ENTRY_LIMIT) -> DataFrame:
    """As queue_flat with a bound for each partition: the row's partition starts with the bound's.

    ``limit`` is the protocol's for a transfer; None takes bounds however many there
    are. Below it a row's partition is cut to each length that bounds have (few, a partition has
    at most 128 characters), and each length is one broadcast join on equal keys,
    instance and prefix. Bounds are one for each key, so no row comes twice, and the
    store isn't shuffled. Beyond, nothing is broadcast by force (see _queue_many).
    """
    diff = written(diff)  # counted, then joined
    size = diff.agg(F.count("*"), F.countDistinct("partition"), F.collect_set(F.length("partition"))).first()
    if limit is not None:
        _within(size[0] + size[1], limit)
    if size[0] + size[1] >= PART_ENTRY_LIMIT:
        return _queue_many(store, diff, profile)
    rows, above = store.where(F.col("profile") == profile), F.lit(False)
    for n in sorted(size[2]):
        i, p, c = f"__i{n}", f"__p{n}", f"__c{n}"
        bound = diff.where(F.length("partition") == n).groupBy(F.col("instance_id").alias(i), F.col("partition").alias(p)).agg(F.min("counter").alias(c))
        rows = rows.join(F.broadcast(bound), (F.col("last_saved_instance") == F.col(i)) & (F.substring("partition", 1, n) == F.col(p)), "left")
        above = above | F.coalesce(F.col("last_saved_counter") > F.col(c), F.lit(False))
    return rows.where(above).select(*store.columns)


def _queue_many(store: DataFrame, diff: DataFrame, profile: str) -> DataFrame:
    """Many records share a partition, so bounds are handed down to the partitions that there are; rows then meet their own by equal keys."""
    own = store.where(F.col("profile") == profile)
    parts = own.select(F.col("partition").alias("path")).distinct()
    below = prefix_join(parts, diff.select(F.col("partition").alias("prefix"), F.col("instance_id").alias("i"), F.col("counter").alias("c")), "path", "prefix")
    bound = below.groupBy("path", "i").agg(F.min("c").alias("c"))
    return own.join(bound, (F.col("partition") == F.col("path")) & (F.col("last_saved_instance") == F.col("i")) & (F.col("last_saved_counter") > F.col("c")), "left_semi")


def buffered(queued: DataFrame, session: str) -> DataFrame:
    """Queued store rows as buffer rows; local state (dirty bit, errors, last session) stays behind."""
    return queued.select(F.lit(session).alias("transfer_session_id"), F.col("id").alias("model_uuid"), *RECORD_COLUMNS)


def buffered_vectors(buffer: DataFrame, rmc: DataFrame) -> DataFrame:
    """All vector entries of buffered records."""
    keys = buffer.select("transfer_session_id", F.col("model_uuid").alias("id"))
    return rmc.join(keys, "id").select("transfer_session_id", F.col("id").alias("model_uuid"), "instance_id", "counter")


def queue_transfer(store: DataFrame, rmc: DataFrame, sender: DataFrame, receiver: DataFrame, filters: Filter, profile: str, session: str) -> tuple[DataFrame, DataFrame]:
    """(buffer, vectors) for a transfer, from the two sides' wire vectors."""
    for wire in (sender, receiver):
        check_partitions(wire, filters)
    lacking = vectors.diff(vectors.expanded(sender, list(filters)), vectors.expanded(receiver, list(filters)))
    buffer = buffered(queue(store, lacking, profile), session)
    return buffer, buffered_vectors(buffer, rmc)
