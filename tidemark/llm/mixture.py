"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stash, unused

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times over.
MOST = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) of each document to (source, n, source_size, target, rate), a row for each source.

    Water filling: the level at which the capped shares sum to all sizes. Sources
    are ordered by the ratio of cap to weight; those below the level are capped.
    A source without words has target and rate 0.
    """
    total = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = total.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")))
    ratio = F.lit(most) * F.col("source_size") / F.col("weight")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.lit(most) * F.coalesce(F.sum("source_size").over(order), F.lit(0))) / F.sum("weight").over(rest)
    filled = weighed.withColumn("ratio", ratio).withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("level"))
    return filled.select("source", "n", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def offset(source: Column, seed: str) -> Column:
    """A fixed random number from 0 to 1 for each source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _mixed(rows: DataFrame, names: list[str], ties: list[Column], seed: str) -> DataFrame:
    """``rows`` with the columns source_size, target and copies, called as the last three of ``names``.

    The first two of ``names`` are the columns that hold source and size; ``ties``
    order rows further.
    """
    source, size, source_size, target, copies = names
    part, place, before, start, rate = unused(rows, "part", "place", "before", "start", "rate")
    order = [F.col(source).asc_nulls_last(), F.col(size), *ties]
    ranged = numbered(rows, order, part, place, "ranges")
    targets = source_targets(ranged.select(F.col(source).alias("source"), F.col(size).alias("size")))
    counts = ranged.groupBy(source, part).agg(F.count("*").alias("c"), F.min(place).alias(start))
    earlier = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(source).alias("s"), F.col(part).alias("p"), start, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias(before))
    known = stash(starts.join(targets, F.col("s").eqNullSafe(F.col("source"))).select("s", "p", start, before, "source_size", "target", F.col("rate").alias(rate)), "targets")
    known = known.withColumnsRenamed({"s": unused(ranged, "s")[0], "p": unused(ranged, "p")[0]})
    known = known.withColumnsRenamed({"source_size": source_size, "target": target})
    s, p = known.columns[:2]
    small = known.count() <= 100_000  # a row for each source and range
    both = ranged.join(F.broadcast(known) if small else known, ranged[source].eqNullSafe(known[s]) & (ranged[part] == known[p]))
    rank = F.col(before) + F.col(place) - F.col(start) + 1
    reached = lambda k: F.floor(offset(F.col(source), seed) + F.col(rate) * k)
    drawn = F.least(reached(rank) - reached(rank - 1), F.ceil(rate)).cast("long")
    return both.withColumn(copies, drawn).select(*rows.columns, source_size, target, copies)


def taken_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies (long).

    Within a source documents stand in order of size, each with the same expected
    number of copies (target over source size); so the prefix sum of expected
    copies is that number times the rank. The sum plus one random offset is taken
    down to whole numbers, and a document comes once for each number reached in
    it. The order makes copies of like sizes evenly spaced, so the words taken stay
    near the target. Prefix sums need no source in one task: all rows are cut into
    ranges of (source, size, doc_id), however many there are, and a rank in a range
    is shifted by the counts of the ranges before it. Where the cuts lie changes no
    rank.

    Null texts have size 0; null sources are a source of their own, last by name;
    repeated rows are documents of their own, dealt to ranges as if they differed;
    an empty table gives none. Ids may be of any type that Spark sorts.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return _mixed(sizes, ["source", "size", "source_size", "target", "copies"], [F.col("doc_id").asc_nulls_first(), F.monotonically_increasing_id()], seed)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mixed corpus: ``docs`` with each row as often as it is taken, all columns kept.

    The copies are those of ``taken_copies``. Rows of one source, size and doc_id
    stand in the order of their texts; rows that agree in all of these are taken
    as if they stood in the order of the input.
    """
    size, source, source_size, target, copies, copy = unused(docs, "size", "named", "source_size", "target", "copies", "copy")
    rows = docs.withColumn(size, word_count(F.col(text_col))).withColumn(source, F.col(source_col).cast("string"))
    ties = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col), F.monotonically_increasing_id()]
    taken = _mixed(rows, [source, size, source_size, target, copies], ties, seed).where(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
