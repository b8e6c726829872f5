"""Tables laid out by record id, so that merges don't shuffle what is there already."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Column by which each table is laid out; all name the same record.
BY = {"store": "id", "rmc": "id", "buffer": "model_uuid", "rmcb": "model_uuid"}
BUCKETS = 200
#: Rows of vectors that a bucket has, about.
ROWS = 200_000


def enough(rows: int, least: int = 16) -> int:
    """Buckets for tables the largest of which has so many rows, so that a bucket, and with it a task, doesn't grow with them."""
    return max(least, -(-rows // ROWS))


def write(df: DataFrame, kind: str, path: str, buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by its record id, sorted in each, at a path of the shared storage; the table read back.

    Tables of one number of buckets meet in joins on the id, and are grouped by it,
    without an exchange: store, vectors and buffers that are merged again and again
    are shuffled once, when written. Choose buckets so that one fits a task (some
    hundred megabytes); all tables that meet have to have as many.
    """
    spark: SparkSession = df.sparkSession
    table = name or f"tidemark_{kind}_{uuid.uuid4().hex}"
    by = BY[kind]
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    return spark.table(table)
