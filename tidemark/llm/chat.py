"""Chat formatting: cumulative snapshots of logged conversations collapse to the longest, then rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Salts of the two hashes that make up a 124-bit key of a turn prefix.
SALTS = ("a", "b")


def _numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their place p in the conversation; null roles and texts count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.withColumn("p", F.row_number().over(order))


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns with rolling hashes of the prefix that ends in them.

    The hash of a turn covers its place, role and text, so the running sum over a
    conversation is the same just if the turns up to there are. Two salted sums
    of 62-bit hashes, taken as decimals, make collisions out of the question.
    """
    run = Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(salt), "p", "role", "text"), 2).cast("decimal(38, 0)")
    whole = Window.partitionBy("conv_id")
    out = turns.select("conv_id", "p", *[piece(s).alias(f"t{s}") for s in SALTS])
    return out.select("conv_id", "p", F.count("*").over(whole).alias("n"), *[F.sum(f"t{s}").over(run).alias(f"h{s}") for s in SALTS])


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged): conversations that are no prefix of a longer one.

    Of equal conversations the least conv_id stays, n_logged says how many there
    were. The prefixes of one system prompt are merged before they meet, so a very
    common first turn is one row of the anti-join.
    """
    keys = ["p", *[f"h{s}" for s in SALTS]]
    prefixes = _prefixes(_numbered(conversations))
    whole = prefixes.where("p = n").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    proper = prefixes.where("p < n").select(*keys).distinct()
    return whole.join(proper, keys, "left_anti").select("conv_id", F.col("p").cast("long").alias("n_turns"), "n_logged")


def rendered(role: Column, text: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    return F.concat(F.lit(start), role, F.lit("\n"), text, F.lit(end + "\n"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged, text): each maximal conversation in the chat template.

    Turns stand by number, then role, then text; a null conv_id is a conversation
    of its own; repeated rows are turns of their own. Other columns are left out.
    One conversation becomes one string and so has to fit in a row.
    """
    turns = _numbered(conversations).withColumnRenamed("conv_id", "id")
    kept = maximal_conversations(conversations)
    said = turns.join(kept.select("conv_id", "n_turns", "n_logged"), F.col("id").eqNullSafe(F.col("conv_id")))
    lines = said.groupBy("conv_id", "n_turns", "n_logged").agg(F.array_sort(F.collect_list(F.struct("p", rendered(F.col("role"), F.col("text")).alias("line")))).alias("lines"))
    return lines.select("conv_id", "n_turns", "n_logged", F.array_join(F.col("lines.line"), "").alias("text"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS p, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY p) AS text FROM t GROUP BY conv_id
), x AS (
  SELECT conv_id, p, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY p) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), u AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_logged, text FROM c GROUP BY n_turns, text
)
SELECT conv_id, n_turns, n_logged, text FROM u WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.p < x.n AND x.p = u.n_turns AND x.prefix = u.text)
"""
