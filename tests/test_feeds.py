"""Pages and changes as data sources: what they open, where streams go on, what they leave out."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scope import Filter
from tidemark.operators import exchange, merge, progress, summary
from tidemark.operators.capture import Model
from tidemark.plans.derive import MEETING, SESSION, Tables
from tidemark.plans.replica import Replica
from tidemark.schemas import BUFFER, RMCB, STORE
from tidemark.sources import buckets, feeds
from tidemark.sources.pages import read_pages, write_pages
from tidemark.sources.snapshots import Snapshots
from tidemark.streaming.ingest import merge_batch, merge_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve pages or so of a session, four to a file, beside another session whose name needs escaping."""
    t, root = Tables(spark, SF), str(tmp_path_factory.mktemp("pages"))
    buffer, rmcb = t.buffer.cache(), t.rmcb.cache()
    write_pages(buffer, rmcb, root, size=100, per_file=4)
    other = buffer.limit(30).withColumn("transfer_session_id", F.lit("a:b/c=d"))
    write_pages(other, rmcb.limit(0), root, size=10, per_file=4)
    return root


def whole(df):
    return sorted(map(str, df.collect()))


def broken(path, first):
    """A copy of the folder in which files of earlier pages can't be read."""
    for file in Path(path).glob(f"session={SESSION}/start=*/*.gz"):
        if int(file.parent.name.removeprefix("start=")) < first:
            file.write_bytes(b"not a gzip file")


def test_pages_as_a_source(spark, folder):
    columns = feeds.PAGED.fieldNames()
    assert whole(feeds.pages(spark, folder, SESSION)) == whole(read_pages(spark, folder, SESSION).select(*columns))
    assert whole(feeds.pages(spark, folder, "a:b/c=d", 2)) == whole(read_pages(spark, folder, "a:b/c=d", 2).select(*columns)) != []
    assert feeds.pages(spark, folder).count() == read_pages(spark, folder).count()
    assert feeds.pages(spark, folder, "none").isEmpty() and feeds.pages(spark, folder, SESSION, 1_000).isEmpty() and feeds.pages(spark, f"{folder}/nothing").isEmpty()


def test_a_pull_goes_on_without_opening_earlier_files(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "x")
    want = whole(read_pages(spark, folder, SESSION, 6).select(*feeds.PAGED.fieldNames()))
    broken(tmp_path / "x", 4)
    assert whole(feeds.pages(spark, str(tmp_path / "x"), SESSION, 6)) == want
    assert whole(read_pages(spark, str(tmp_path / "x"), SESSION, 6).select(*feeds.PAGED.fieldNames())) == want
    with pytest.raises(Exception):
        feeds.pages(spark, str(tmp_path / "x"), SESSION, 3).collect()


def test_a_stream_goes_on_at_the_page(spark, folder, tmp_path):
    """Files that came are read once, in order; one that comes before those in front of it waits."""
    import shutil

    source, got = tmp_path / "x", []
    files = sorted(Path(folder).glob(f"session={SESSION}/start=*"), key=lambda p: int(p.name.removeprefix("start=")))
    assert len(files) >= 3

    def arrive(file):
        shutil.copytree(file, source / f"session={SESSION}" / file.name)

    def run():
        rows = feeds.stream_session(spark, str(source), SESSION, per_file=4)
        each = lambda batch, n: got.append([r.page for r in batch.select("page").distinct().collect()])
        rows.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {p for batch in got for p in batch}

    arrive(files[0])
    arrive(files[2])
    assert run() == set(range(4))
    broken(source, 4)  # what was read isn't opened again
    arrive(files[1])
    assert run() == set(range(12))
    before = len(got)
    for file in files[3:]:
        arrive(file)
    last = {r.page for r in read_pages(spark, folder, SESSION).select("page").distinct().collect()}
    assert run() == last and all(sum(p in b for b in got) == 1 for p in last) and len(got) <= before + 1


def test_changes_once_each(spark, tmp_path):
    t = Tables(spark, SF)
    s = Snapshots(spark, f"{tmp_path}/r")
    store = t.store.limit(50).cache()
    s.commit({"store": store, "rmc": t.rmc.limit(0)})
    got = []

    def run():
        rows = feeds.stream_changes(spark, s.root, "store", after=1)
        each = lambda batch, n: got.extend(batch.collect())
        rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    change = store.limit(3).withColumn("serialized", F.lit("new"))
    s.commit({}, {"store": (change, ["id"])})
    run()
    want = sorted(r.id for r in change.collect())
    assert sorted(r.id for r in got) == want and {(r.serialized, r._version, r._whole, r.profile) for r in got} == {("new", 2, False, "facility")}
    for n in range(17):
        s.commit({}, {"store": (store.limit(1).withColumn("last_saved_counter", F.lit(n)), ["id"])})
    s.compact()  # new files, nothing new in them
    s.commit({"other": store.select("id")})
    run()
    assert [r.last_saved_counter for r in sorted(got[3:], key=lambda r: r._version)] == list(range(17))
    assert whole(feeds.changes(spark, s.root, "store", 1).select("id", "_version")) == whole(spark.createDataFrame([(r.id, r._version) for r in got], "id string, _version long"))
    s.commit({"store": store})
    whole_again = feeds.changes(spark, s.root, "store", s.version - 1)
    assert whole(whole_again.select(*STORE.fieldNames())) == whole(store.select(*STORE.fieldNames())) and {r._whole for r in whole_again.collect()} == {True}
    s.expire(1)
    with pytest.raises(Exception, match="take the table whole"):
        feeds.changes(spark, s.root, "store", 1).collect()


def test_types_of_directory_columns(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/r")
    rows = spark.createDataFrame([("a", None, "m=1/x", 1, [1, None], "2020-01-01"), ("b", "p q", "", 2, None, None)], "id string, profile string, model_name string, n int, list array<int>, at string").withColumn("at", F.to_timestamp("at"))
    s.commit({"store": rows})
    assert whole(feeds.changes(spark, s.root, "store").select(*rows.columns)) == whole(s.read("store").select(*rows.columns))


def test_stream_and_replica_both_commit(spark, tmp_path):
    """A batch is merged while a replica that has loaded the version before works: neither loses anything."""
    t = Tables(spark, SF)
    model = Model("note", __import__("pyspark").sql.types.StructType.fromDDL("id string, text string"))
    s = Snapshots(spark, f"{tmp_path}/r")
    Replica(spark, [model], "facility", "own").save(s)
    buffer = t.buffer.limit(40).cache()
    wire = exchange.nested(buffer, t.rmcb.join(buffer.select("model_uuid"), "model_uuid")).cache()
    tries = []

    def work(replica):
        replica.upsert("note", spark.createDataFrame([("n1", "hello")], "id string, text string"))
        replica.serialize()
        if not tries:  # the stream is faster the first time
            tries.append(merge_batch(s, wire, "own", Filter(""), "facility", lambda: 70))

    Replica.updated(s, [model], work)
    assert tries == [[SESSION]] and s.version == 3
    kinds = {r.model_name: r["count"] for r in s.read("store").groupBy("model_name").count().collect()}
    assert kinds == {"order": buffer.count(), "note": 1}
    retried = []

    class Late(Snapshots):
        def commit(self, *args, **kwargs):  # a replica is faster the first time
            if not retried:
                retried.append(Replica.updated(s, [model], lambda r: r.upsert("note", spark.createDataFrame([("n2", "again")], "id string, text string"))))
            return super().commit(*args, **kwargs)

    again = wire.withColumn("serialized", F.lit('{"k":9}')).withColumn("last_saved_counter", F.col("last_saved_counter") + 1_000)
    merge_batch(Late(spark, s.root), again, "own", Filter(""), "facility", lambda: 71)
    assert s.version == 5 and s.read("app-note").count() == 2
    assert s.read("store").where("model_name = 'order' and last_saved_counter < 1000 and last_saved_instance <> 'own'").isEmpty()


def test_rules_hold_in_the_stream(spark, tmp_path):
    """A model's rule for conflicts gives the same text by a batch as by a replica's merge."""
    t = Tables(spark, SF)
    both = lambda a, b: F.concat(a, F.lit(" / "), b)
    model = Model("order", __import__("pyspark").sql.types.StructType.fromDDL("id string, k long"), resolve_conflict=both)
    buffer, rmcb = (x.cache() for x in t.meeting())
    store, rmc = t.store.cache(), t.rmc.cache()
    s = Snapshots(spark, f"{tmp_path}/r")
    s.commit({"store": store, "rmc": rmc})
    clock = iter(range(500, 510))
    merge_batch(s, exchange.nested(buffer, rmcb), "i3", Filter(""), "facility", lambda: next(clock), models=[model])
    replica = Replica(spark, [model], "facility", "i3", 499)
    replica.store, replica.rmc, replica.buffer, replica.rmcb = store, rmc, buffer, rmcb
    empty = spark.createDataFrame([], "side string, partition string, instance_id string, counter int")
    for name in MEETING:
        replica.dequeue(name, empty)
    columns = STORE.fieldNames()
    assert whole(s.read("store").select(*columns)) == whole(replica.store.select(*columns)) and whole(s.read("rmc")) == whole(replica.rmc.select("id", "instance_id", "counter"))
    assert not s.read("store").where("serialized like '% / %'").isEmpty()


def test_batches_keep_the_summary(spark, tmp_path):
    """Counts by partition and instance after batches that bring conflicts are those of a whole count."""
    t = Tables(spark, SF)
    buffer, rmcb = (x.cache() for x in t.meeting())
    s = Snapshots(spark, f"{tmp_path}/r")
    s.commit({"store": t.store, "rmc": t.rmc, "summary": summary.counted(t.store, t.rmc)})
    for name in MEETING:
        mine = F.col("transfer_session_id") == name
        merge_batch(s, exchange.nested(buffer.where(mine), rmcb.where(mine)), "i3", Filter(""), "facility", lambda: 500)
    assert whole(s.read("summary").where("records > 0").select(*summary.KEY, "records")) == whole(summary.counted(s.read("store"), s.read("rmc")).select(*summary.KEY, "records"))


def test_progress_of_a_stream(spark, tmp_path):
    """A listener's records and bytes are those of the files, batch by batch."""
    t = Tables(spark, SF)
    buffer = t.buffer.cache()
    s = Snapshots(spark, f"{tmp_path}/r")
    s.commit({"store": t.store.limit(0), "rmc": t.rmc.limit(0)})
    write_pages(buffer, t.rmcb, f"{tmp_path}/x", size=100, per_file=4)
    told = progress.Progress()
    spark.streams.addListener(told)
    try:
        merge_stream(spark, f"{tmp_path}/x", s, f"{tmp_path}/c", "i3", Filter(""), "facility", lambda: 500).awaitTermination()
        for _ in range(100):
            if told.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
    (total,) = told.totals.values()
    size = buffer.agg(F.sum(F.octet_length("serialized") + F.octet_length("conflicting_serialized_data"))).first()[0]
    assert total["records"] == buffer.count() and total["bytes"] == size and list(told.ended.values()) == [None]


def test_buckets_are_not_shuffled(spark, tmp_path):
    t = Tables(spark, SF)
    store, buffer, rmc, rmcb = (buckets.write(df, kind, f"{tmp_path}/{kind}", 8) for kind, df in {"store": t.store, "buffer": t.buffer, "rmc": t.rmc, "rmcb": t.rmcb}.items())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in merge.changes(store, buffer, rmc, rmcb, "i3", 500, SESSION):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert whole(merge.merge(store, buffer, rmc, rmcb, "i3", 500, SESSION)[0]) == whole(merge.merge(t.store, t.buffer, t.rmc, t.rmcb, "i3", 500, SESSION)[0])


def test_small_files_share_a_task(spark, tmp_path):
    """A transfer of many small files is not as many tasks, and none is lost or read twice."""
    files = [(f"f{i}", 10_000) for i in range(1000)] + [("big", 1 << 30), ("after", 1)]
    parts = feeds._together(iter(files), 3)
    assert [p for part in parts for p in part.paths] == [f for f, _ in files] and len(parts) == 18 and all(part.first == 3 for part in parts)
    buffer = spark.range(300).selectExpr("'t' as transfer_session_id", "lpad(hex(id), 32, '0') as model_uuid", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in BUFFER if f.name not in ("transfer_session_id", "model_uuid")])
    write_pages(buffer, spark.createDataFrame([], RMCB), f"{tmp_path}/pages", size=5, per_file=1)
    got = feeds.pages(spark, f"{tmp_path}/pages", "t", first=7)
    assert got.rdd.getNumPartitions() == 1 and sorted(r.model_uuid for r in got.collect()) == [f"{i:032X}" for i in range(35, 300)]


def test_buckets_follow_rows():
    """A bucket doesn't grow with its table."""
    assert buckets.enough(0) == buckets.enough(600_000) == 16
    for rows in (36_000_000, 216_000_000):
        assert rows / buckets.enough(rows) <= buckets.ROWS
