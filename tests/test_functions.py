from __future__ import annotations

import hashlib
import json
import zlib

from pyspark.sql import functions as F

from tidemark.functions import identity, payload, scope
from tidemark.functions.scope import Filter, Scope


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_ids(spark):
    want = hashlib.sha256(b"${id}:user::bob::user").hexdigest()[:32]
    r = one(spark, id=identity.record_id(F.lit("${id}:user"), F.lit("bob"), F.lit("user")), where=identity.placed(F.lit("${id}:user"), F.lit("x")), back=identity.unplaced(F.lit("x:user"), F.lit("x")))
    assert (r.id, r.where, r.back) == (want, "x:user", "${id}:user")
    r = one(spark, a=identity.composed_id(F.lit("a"), F.lit(""), F.lit("b")), b=identity.composed_id(F.lit(""), F.lit(None).cast("string")))
    assert r.a == hashlib.sha256(b"a:b").hexdigest()[:32] and len(r.b) == 32
    r = one(spark, a=identity.plain_uuid(F.lit("AAAAAAAA-BBBB-CCCC-DDDD-EEEEEEEEEEEE")), b=identity.plain_uuid(F.lit("zz")))
    assert (r.a, r.b) == ("aaaaaaaabbbbccccddddeeeeeeeeeeee", None)
    assert one(spark, k=identity.lock_key(F.lit("p" * 40))).k == zlib.crc32(b"p" * 32) - 2147483647
    assert identity.filled("${a}:${b}", {"a": "x"}) == "x:${b}"


def test_proquints(spark):
    def name(n):  # four bits and two bits in turn, sixteen to a group
        groups = []
        while n or not groups:
            g = ""
            for j in range(5):
                g, n = (identity.CONSONANTS[n & 15] + g, n >> 4) if j % 2 == 0 else (identity.VOWELS[n & 3] + g, n >> 2)
            groups.insert(0, g)
        return "-".join(groups)

    numbers = [0, 1, 65535, 65536, 0x7F000001, 2**32 - 1, 2**40 + 5]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", identity.proquint(F.col("n")).alias("p"), identity.from_proquint(identity.proquint(F.col("n"))).alias("b")).collect()
    assert all(r.p == name(r.n) and r.b == r.n for r in rows)
    assert one(spark, bad=identity.from_proquint(F.lit("babab-xx"))).bad is None
    assert one(spark, s=identity.short_name(F.lit("7f000001" + "0" * 24))).s == "lusabbabad"


def test_hashes(spark):
    r = one(spark, h=identity.system_hash(F.lit("ABC")), e=identity.system_hash(F.lit("")), m=identity.mac_text(F.lit(0x0300000000FF)))
    assert r.h == hashlib.sha1(("ABC" + identity.SYSTEM_SALT).lower().encode()).hexdigest()[:20] and r.e == ""
    assert r.m == "03:00:00:00:00:ff"
    r = one(spark, a=identity.mac_is_multicast(F.lit("03:00")), b=identity.mac_is_local(F.lit("03:00")), c=identity.mac_is_local(F.lit("01:00")))
    assert (r.a, r.b, r.c) == (True, True, False)


def test_filters():
    assert Filter("").prefixes == ("",) and "anything" in Filter("")
    assert (Filter("") + Filter("a")).prefixes == ("a",)  # a blank one vanishes beside another
    assert (Filter("") + Filter("")).prefixes == ("",)  # two blank ones match everything
    f = Filter("${m}:x\n y", {"m": "p"})
    assert f.prefixes == ("p:x", "y") and len(f) == 2 and str(f) == "p:x\ny"
    assert Filter("p:x:1 yy") <= f and not (Filter("p") <= f) and Filter("y p:x") == f
    assert "p1i" in Filter("p1")  # plain prefixes, no path segments
    assert "P1" not in Filter("p1") and "pa1" not in Filter("p_1")


def test_scopes():
    root = Scope(read_write="${m}", params={"m": "p"})
    sub = Scope(read_only="${m}", write_only="${m}:${s}", params={"m": "p", "s": "q"})
    assert sub <= root and not root <= sub
    assert sub.allows(Filter("p:q:1"), root, push=True) and not sub.allows(Filter("p:z"), root, push=True) and sub.allows(Filter("p:z"), root, push=False)


def test_column_filters(spark):
    arrays = spark.createDataFrame([(["p1i"], ["p1"]), (["p"], ["p1"]), ([""], [""]), (["a", "b"], ["b", "a"])], "a array<string>, b array<string>")
    rows = arrays.select(scope.subset(F.col("a"), F.col("b")).alias("s"), scope.equal(F.col("a"), F.col("b")).alias("e")).collect()
    assert [(r.s, r.e) for r in rows] == [(True, False), (False, False), (True, True), (True, True)]
    assert one(spark, p=scope.prefixes_of(F.lit("  a\n b "))).p == ["a", "b"] and one(spark, p=scope.prefixes_of(F.lit(" "))).p == [""]
    plan = spark.createDataFrame([("p1",)], "partition string").where(scope.any_prefix("partition", ["p1", "q"]))
    assert plan.count() == 1


def test_payloads(spark):
    r = one(spark, m=payload.merged(F.lit('{"a": 1, "b": {"x": [1]}, "c": null}'), F.lit('{"a": "z", "d": null}')), e=payload.merged(F.lit(""), F.lit('{"a": 1}')))
    assert json.loads(r.m) == {"a": "z", "b": {"x": [1]}, "c": None, "d": None} and json.loads(r.e) == {"a": 1}
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(rows.select(payload.payload(["a", "b"], ["a"]).alias("j")).first().j) == {"a": "1", "b": None}


def test_macs_of_more_than_48_bits(spark):
    """What doesn't fit six pairs stays behind the last, as in the SQL of system_hashes (41,000 * 7,000,000,019 has 13 digits)."""
    r = one(spark, m=identity.mac_text(F.lit(0x1050505050505)), s=identity.mac_text(F.lit(0xFF)), n=identity.mac_text(F.lit(None).cast("long")))
    assert (r.m, r.s, r.n) == ("10:50:50:50:50:505", "00:00:00:00:00:ff", None)
