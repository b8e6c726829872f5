"""One query for each operator of this subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fim, minhash, mixture, pii, secrets, simhash, substring, toxicity, vectorcodes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.fit(docs, _table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "max_window")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("item_ids", ","), "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(_table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(_table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixture.taken_copies(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edited(_table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")).withColumn("ids_sha256", F.sha2("ids", 256)))
    return plain.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    made = fim.transform(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    books = vectorcodes.train(vectors)
    coded = vectorcodes.with_label_errors(vectorcodes.encode(vectors, books, label_col="label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_decontamination, op3_simhash, op4_secrets, op5_warc, op6_pii, op7_substring, op8_mixture, op9_minhash, op10_chat, op11_bpe, op12_fill_in_middle, op13_vector_codes)
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format("text")}, []) AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT x.doc_id, x.i, x.k, g.item_id FROM x JOIN g ON x.k = g.k AND x.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT x.doc_id, x.i FROM x JOIN (SELECT h FROM x GROUP BY h HAVING count(*) > 1) USING (h)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN c USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
#: Ranks are exact in both at every size, see tests/llm/test_mixture_large.py.
OP8 = r"""
WITH z AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM z GROUP BY source),
r AS (SELECT *, 3 * source_size::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS top FROM l),
t AS (SELECT source, source_size, CASE WHEN top IS NULL OR ratio <= top THEN 3 * source_size::DOUBLE ELSE weight * top END AS target,
  ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM m),
k AS (SELECT z.doc_id, z.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, row_number() OVER (PARTITION BY z.source ORDER BY z.size, z.doc_id) AS rank
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, least(floor(u + rate * rank) - floor(u + rate * (rank - 1)), ceil(rate))::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM n
"""
OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(w[1:i], '') AS a, array_to_string(w[i + 1:j], '') AS b, array_to_string(w[j + 1:], '') AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def _rounds(n: int) -> str:
    """Assignments and moved entries of each round, then the last assignments; floor of a quotient whatever the sign."""
    out = []
    for r in range(n + 1):
        out.append(f"d{r} AS (SELECT rid, part, entry, sum((v - c) * (v - c))::BIGINT AS d FROM x JOIN b{r} USING (part, pos) GROUP BY rid, part, entry)")
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, part, min(d * 64 + entry) % 64 AS entry, min(d * 64 + entry) // 64 AS d FROM d{r} GROUP BY rid, part)")
        if r < n:
            out.append(f"u{r} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (rid, part) GROUP BY part, entry, pos)")
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM b{r} LEFT JOIN u{r} USING (part, entry, pos))")
    return ",\n".join(out)


#: For vectors of one length that is a multiple of 16.
OP13 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding, len(embedding) // 16 AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT rid, i // width AS part, i % width AS pos, floor(256 * e::DOUBLE)::BIGINT AS v FROM (SELECT rid, width, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS e FROM k)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, v AS c FROM x WHERE rid <= 64),
{_rounds(2)},
e AS (SELECT rid, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM k JOIN e USING (rid)
"""
ORACLES: dict[str, str] = {"op12_fill_in_middle": OP12, "op13_vector_codes": OP13, "op2_decontamination": OP2, "op5_warc": warc.ORACLE, "op7_substring": OP7, "op8_mixture": OP8, "op10_chat": chat.ORACLE}
