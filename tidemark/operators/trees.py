"""Recursive questions: closures over parent links and over foreign keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import trusted

#: Rounds of a level-by-level loop between two writes of all that was seen.
COMPACT_ROUNDS = 8
#: Levels that a closure takes one by one, before it doubles its steps.
SINGLE_STEPS = 4


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in local mode may the setting be missing; a temporary folder stands in then."""
    trusted(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that loops neither grow plans nor fear lost executors."""
    spark: SparkSession = trusted(df.sparkSession)
    if spark.sparkContext.getCheckpointDir() is None:
        base = _shared_folder(spark)
        if not spark.conf.get("spark.checkpoint.dir", None):
            spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """As ``cut``, by a table in the shared folder, removed when Python exits.

    A checkpoint keeps the constraints that the optimizer derived; in a closure
    they multiply from round to round until no plan compiles. A table starts afresh.
    """
    spark: SparkSession = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder, removed when Python exits."""
    path = f"{_shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _drop(df.sparkSession, path)


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(table, True)
    except Exception:  # the session is gone; the folder is the cluster's to clean
        pass


def reach(seed: DataFrame, links: DataFrame) -> DataFrame:
    """(id, depth): what can be reached from ``seed`` (id) over ``links`` (parent, child), each at its least depth.

    ``links`` are those of a forest, up or down: of parents or of children each has
    one partner. The first levels, all there are in most trees, are taken one by
    one, each from the ids that the last one brought. Then steps double, so that a
    chain of n links takes log2(n) rounds. Ids met before are dropped, so cycles end.
    """
    seen = frontier = written(seed.select("id").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, SINGLE_STEPS + 1):
        step = frontier.join(links, frontier["id"] == links["parent"]).select(links["child"].alias("id")).distinct()
        frontier = written(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    return seen.union(_doubled(frontier, links)).groupBy("id").agg(F.min("depth").alias("depth"))


def _doubled(start: DataFrame, links: DataFrame) -> DataFrame:
    """(id, depth) of ``start`` (id, depth) and all it reaches over ``links``, by pointers that double in each round.

    After k rounds ``jumps`` has the pairs 2 ** k links apart, and ``found`` all ids
    less than 2 ** k links from the start; what neither gains nor can gain is whole.
    Pairs run out with the longest chain.
    """
    found, jumps, length = start, written(links.select("parent", "child").distinct()), 1
    known = found.count()
    while True:
        step = found.join(jumps, found["id"] == jumps["parent"]).select(jumps["child"].alias("id"), (F.col("depth") + length).alias("depth"))
        grown = written(found.unionByName(step).groupBy("id").agg(F.min("depth").alias("depth")))
        if found is not start:
            discard(found)
        found, before, known = grown, known, grown.count()
        if known == before:
            discard(jumps)
            return found
        first, second = jumps.toDF("parent", "middle"), jumps.toDF("middle", "child")
        last, jumps, length = jumps, written(first.join(second, "middle").select("parent", "child").distinct()), 2 * length
        discard(last)


def ancestors(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, depth) of the ids and all above them, for a tree (id, parent_id)."""
    up = tree.where("parent_id is not null").select(F.col("id").alias("parent"), F.col("parent_id").alias("child"))
    return reach(ids, up)


def descendants(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, depth) of the ids and all below them."""
    down = tree.where("parent_id is not null").select(F.col("parent_id").alias("parent"), F.col("id").alias("child"))
    return reach(ids, down)


def cascade(roots: dict[str, DataFrame], tables: dict[str, DataFrame], keys: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """What a delete takes along: table name to (id).

    ``keys`` are (child table, column, parent table) with parents before their
    children; a table that refers to itself is closed over its own links.
    """
    gone = {name: rows.select("id").distinct() for name, rows in roots.items()}
    empty = lambda t: tables[t].select("id").limit(0)
    for child in dict.fromkeys(k[0] for k in keys):
        found = gone.get(child, empty(child))
        for _, column, parent in [k for k in keys if k[0] == child and k[2] != child]:
            if parent in gone:
                found = found.union(tables[child].join(gone[parent].select(F.col("id").alias("__p")), F.col(column) == F.col("__p"), "left_semi").select("id"))
        for _, column, parent in [k for k in keys if k[0] == child == k[2]]:
            links = tables[child].where(F.col(column).isNotNull()).select(F.col(column).alias("parent"), F.col("id").alias("child"))
            found = reach(found, links).select("id")
        gone[child] = found.distinct()
    return gone
