from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import exchange
from tidemark.plans.derive import Tables
from tidemark.plans.queries import QUERIES
from tidemark.plans.sql import ORACLES
from tidemark.session import trusted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(names, values):
    at = [names.index(n) for n in sorted(names)]
    return sorted(repr([v[i] for i in at]) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a = rows(got.columns, [tuple(r) for r in got.collect()])
    assert a == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_queue_plan_has_no_cartesian_product(spark):
    plan = QUERIES["queue_v2"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_owners_of_levels_are_there(spark, tmp_path):
    """With 12 suppliers the last owner is one by the SQL; keys start at 0."""
    c = duckdb.connect()
    spark.read.parquet(f"{SF}/supplier.parquet").limit(1).crossJoin(spark.range(12)).withColumn("s_suppkey", F.col("id")).drop("id").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey < 60").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("supplier", "customer"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got, want = entry.queries()["restore_levels"](spark, str(tmp_path)), c.sql(entry.oracle_sql()["restore_levels"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_meeting_as_wire(spark):
    """Wire records that are gathered for each order are those that nesting the two tables gives."""
    t = Tables(trusted(spark), SF)
    plain, direct = exchange.nested(*t.meeting()), t.meeting_wire()
    assert sorted(map(str, plain.select(*direct.columns).collect())) == sorted(map(str, direct.collect()))


def test_wire_records_as_nested(spark):
    """Wire records made order by order are those that buffer and vectors give."""
    t = Tables(spark, SF)
    text = lambda df: sorted(df.select(F.to_json(F.struct(*df.columns))).toArrow().column(0).to_pylist())
    assert text(t.wire) == text(exchange.nested(t.buffer, t.rmcb).select(*t.wire.columns))


@pytest.mark.parametrize("name", ["dequeue_store", "reverse_ff"])
def test_vectors_stay_with_their_records(spark, name):
    """A merge deals store and buffer by id and not each vector entry beside them."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "hashpartitioning(model_uuid" not in plan
