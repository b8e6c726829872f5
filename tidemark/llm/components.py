"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stash, unused


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node long, root long), root the least node of a component.

    Every round writes its edges to the shared folder, so a lost executor costs
    no more than a round. A hub's neighbours meet in a join that adaptive
    execution can split; its least neighbour is found with partial aggregation.
    Rounds grow with the logarithm of the component size.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (sign := now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()) != before:
        before = tuple(sign)
        if not sign[0]:
            break
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, now = now, stash(small.where("u <> v").distinct(), "edges")
        discard(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def text_key(text: Column) -> Column:
    """What tells rows of one id apart: a hash of the text, null counting as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def leaders(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group of ``found`` (doc_id, th, root), a row of it for each of ``docs``.

    ``th`` is the row's ``text_key``. The row of least doc_id stays, null ids last, and
    of one id that of least text key; so of a group without ids one row stays too,
    and rows that share an id but no group are told apart. Of rows that agree in id
    and text one stays. Groups are summed up before they are shuffled.
    """
    who, key = unused(docs, "who", "key")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    first = first.select(F.col("f.doc_id").alias(who), F.col("f.th").alias(key)).distinct()
    kept = docs.join(first, F.col(id_col).eqNullSafe(F.col(who)) & (text_key(F.col(text_col)) == F.col(key)), "left_semi")
    if found.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        return kept
    same = kept.groupBy(F.col(id_col).alias(who), text_key(F.col(text_col)).alias(key))
    return same.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
