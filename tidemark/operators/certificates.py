"""What a certificate may do: no more than the one above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scope import subset
from .trees import descendants


def judged_chains(certificates: DataFrame) -> DataFrame:
    """Certificates (id, parent_id, read array, write array) with ``valid``.

    A certificate holds if its scope lies within its parent's and its parent holds;
    one whose parent is unknown doesn't. So those that exceed their parent are found
    by one join, and whatever descends from them goes as well.
    """
    parent = certificates.select(F.col("id").alias("p"), F.col("read").alias("pr"), F.col("write").alias("pw"))
    both = certificates.join(parent, F.col("parent_id") == F.col("p"), "left")
    within = F.col("p").isNotNull() & subset(F.col("read"), F.col("pr")) & subset(F.col("write"), F.col("pw"))
    bad = both.where(F.col("parent_id").isNotNull() & ~within).select("id")
    gone = descendants(certificates, bad).select("id", F.lit(True).alias("gone"))
    return certificates.join(gone, "id", "left").withColumn("valid", F.col("gone").isNull()).drop("gone")
