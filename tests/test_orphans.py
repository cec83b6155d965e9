from datetime import datetime

from pyspark.sql import functions as F

from graphloom.operators import orphans
from graphloom.operators.orphans import Link, References, find_orphans
from graphloom.operators.skew import hot_keys, salted_join

T1, T2, T3 = datetime(2025, 1, 5), datetime(2025, 2, 5), datetime(2025, 3, 5)
REF = "ref_key string, parent_key string, at timestamp, deleted string"


def setup(spark):
    refs = spark.createDataFrame([("e1", "gone", T1, ""), ("e1", "gone", T1, ""), ("e2", "dead", T1, ""), ("e3", "new", T1, ""), ("e4", "new", T3, ""), ("e5", None, T1, ""), ("e6", "new", None, ""), ("e7", "gone", None, "")], REF)
    parents = spark.createDataFrame([("dead", T1, None), ("dead", T1, T2), ("new", T2, None), ("new", T3, None), (None, T1, None)], "parent_key string, created_at timestamp, deleted_at timestamp")
    return refs, parents


def test_direct(spark):
    refs, parents = setup(spark)
    got = {tuple(r) for r in find_orphans([References("edges", refs)], parents).collect()}
    assert got == {("edges", "e1", "missing", "direct", 0, "2025-01"), ("edges", "e2", "deleted", "direct", 0, "2025-01"), ("edges", "e3", "late", "direct", 0, "2025-01"), ("edges", "e7", "missing", "direct", 0, None)}


def test_the_fixpoint_starts_from_lost_parents(spark, monkeypatch):
    joins = []
    monkeypatch.setattr(orphans, "salted_join", lambda rows, few, key, salt_by, *how: joins.append(few) or salted_join(rows, few, key, salt_by, *how))
    refs, parents = setup(spark)
    refs = refs.unionByName(spark.createDataFrame([("e8", "fine", T3, ""), ("e9", "untimed", T1, "")], REF))
    parents = parents.unionByName(spark.createDataFrame([("fine", T1, None), ("untimed", None, None), ("unasked", T1, T2)], parents.schema))
    views = spark.createDataFrame([("v1", "fine", T3, ""), ("v2", "new", T3, "")], REF)
    unlinked = Link("notes", "elsewhere", spark.createDataFrame([("n1", "e1", T2)], "ref_key string, parent_ref_key string, at timestamp"))
    got = {tuple(r)[:3] for r in find_orphans([References("edges", refs), References("views", views)], parents, [unlinked]).collect()}
    assert got == {("edges", "e1", "missing"), ("edges", "e2", "deleted"), ("edges", "e3", "late"), ("edges", "e7", "missing")}
    # neither parents that lose no reference nor links that nothing reaches are joined
    assert [{(r.parent_key, r.kind) for r in few.collect()} for few in joins] == [{("gone", "missing"), ("dead", "deleted"), ("new", "late")}] * 2


def test_cascade_ends_in_cycles(spark):
    refs, parents = setup(spark)
    copies = spark.createDataFrame([("c1", "e1", T2), ("c1", "e1", T2), ("c2", "e4", T2), ("c3", None, T2)], "ref_key string, parent_ref_key string, at timestamp").withColumn("kind", F.lit("x"))
    notes = spark.createDataFrame([("n1", "c1", T3), ("n2", "n1", T3), ("n1", "n2", T3)], "ref_key string, parent_ref_key string, at timestamp")
    links = [Link("copies", "edges", copies), Link("notes", "copies", notes), Link("notes", "notes", notes)]
    got = {tuple(r)[:5] for r in find_orphans([References("edges", refs)], parents, links).where("origin = 'inherited'").collect()}
    assert got == {("copies", "c1", "missing", "inherited", 1), ("notes", "n1", "missing", "inherited", 2), ("notes", "n2", "missing", "inherited", 3)}


def test_empty(spark):
    refs, parents = setup(spark)
    assert find_orphans([References("edges", refs.limit(0))], parents).collect() == []
    assert {r.kind for r in find_orphans([References("edges", refs)], parents.limit(0)).collect()} == {"missing"}


def test_salted_join_equals_a_join(spark):
    rows = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, i int")
    unique = spark.createDataFrame([("hot", 1), ("k1", 2), ("never", 3)], "k string, v int")
    assert [tuple(r) for r in hot_keys(rows, "k", 0.1).collect()] == [("hot", 3)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, salted_join(rows, unique, "k", "i").select("k", "i", "v").collect())) == sorted(map(key, rows.join(unique, "k", "left").select("k", "i", "v").collect()))
    twice = unique.unionByName(unique).withColumn("v", F.col("v") + F.monotonically_increasing_id())
    twice = spark.createDataFrame(twice.collect(), twice.schema)
    assert sorted(map(key, salted_join(rows, twice, ["k"], "i", "inner").select("k", "i", "v").collect())) == sorted(map(key, rows.join(twice, "k").select("k", "i", "v").collect()))


def test_references_named_by_their_parent_spread(spark, monkeypatch):
    joins = []
    monkeypatch.setattr(orphans, "salted_join", lambda rows, unique, key, salt_by: joins.append((rows, salt_by)) or salted_join(rows, unique, key, salt_by))
    refs = spark.range(200).select(F.lit("m").alias("ref_key"), F.lit("m").alias("parent_key"), F.timestamp_seconds("id").alias("at"))
    parents = spark.createDataFrame([("n", T1, None)], "parent_key string, created_at timestamp, deleted_at timestamp")
    assert [tuple(r) for r in find_orphans([References("views", refs)], parents).collect()] == [("views", "m", "missing", "direct", 0, "1970-01")]
    ((rows, salt_by),) = joins
    salts = hot_keys(rows, "parent_key").collect()[0].salts
    assert salts == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.select(F.pmod(F.xxhash64(salt_by), F.lit(salts))).distinct().count() > salts / 2


def test_periods_are_those_of_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    refs = spark.createDataFrame([("e", "gone", 1_740_783_600)], "ref_key string, parent_key string, s long").select("ref_key", "parent_key", F.timestamp_seconds("s").alias("at"))
    parents = spark.createDataFrame([], "parent_key string, created_at timestamp, deleted_at timestamp")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert [r.period for r in find_orphans([References("edges", refs)], parents).collect()] == ["2025-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
