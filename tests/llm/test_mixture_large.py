"""The mixture of a source beyond any task's size against its SQL."""

from __future__ import annotations

import duckdb

from tidemark.llm import queries

ROWS = 1_100_000


def test_large_sources_rank_as_in_sql(spark, tmp_path):
    text = "repeat('w ', cast(pmod(id * 7919, 13) as int))"
    spark.range(ROWS).selectExpr("id as doc_id", f"{text} as text", "if(id % 50 = 0, null, if(id % 10 = 0, 'b', 'a')) as source").write.parquet(f"{tmp_path}/documents.parquet")
    queries.op8_mixture(spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    duck.sql(f"CREATE TABLE want AS {queries.ORACLES['op8_mixture']}")
    columns = "doc_id, size, source_size, round(target, 3) AS target, taken, copies"
    got = f"SELECT {columns} FROM '{tmp_path}/got/*.parquet'"
    assert duck.sql(f"SELECT count(*) FROM ({got})").fetchall()[0][0] == ROWS
    assert not duck.sql(f"{got} EXCEPT ALL SELECT {columns} FROM want LIMIT 5").fetchall()
