"""Joins on 'the path starts with the prefix'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_join(left: DataFrame, right: DataFrame, path: str, prefix: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in which ``left[path]`` starts with ``right[prefix]`` and the columns ``on`` agree.

    Each path is cut to every length that prefixes have, so that the join is on
    equal keys and shuffles or broadcasts as any other. The lengths come from a
    scalar subquery and are few: a partition name has at most 128 characters.
    ``right``'s columns other than ``on`` must not be in ``left``.
    """
    lengths = right.where(F.col(prefix).isNotNull()).agg(F.collect_set(F.length(prefix))).scalar()
    keyed = left.withColumn("__lengths", lengths).withColumn("__n", F.explode(F.filter("__lengths", lambda n: n <= F.length(path))))
    keyed = keyed.withColumn("__key", F.substring(F.col(path), F.lit(1), F.col("__n"))).drop("__n", "__lengths")
    return keyed.join(right.withColumn("__key", F.col(prefix)), [*on, "__key"]).drop("__key")
