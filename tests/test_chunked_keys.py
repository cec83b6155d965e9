import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions.keys import as_key
from graphloom.operators.chunked_keys import heavy_keys, key_starts, number_rows, profile_keys

SCHEMA = "key string, at long, value long, row long, n long"


def brute(rows, gap):
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == key]
        at = sorted(r[1] for r in mine if r[1] is not None)
        gaps = [b - a for a, b in zip(at, at[1:])]
        values = [r[2] for r in mine if r[2] is not None]
        out[key] = (len(mine), at[0] if at else None, at[-1] if at else None, (max(gaps) if gaps else 0) if at else None, 1 + sum(g > gap for g in gaps) if at else 0, len(values), sum(values) if values else None)
    return out


def measured(spark, rows, gap=5, chunk=7):
    # extra columns with the names that the operator uses inside
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = profile_keys(df, F.col("key"), F.col("at"), F.col("value"), gap, chunk).collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r[1:]) for r in got}


def test_hot_key_nulls_and_repeats(spark):
    random.seed(1)
    rows = [(random.choice(["a", "a", "a", "b", "c", None]), random.choice([None, *range(50)]), random.choice([None, 1, 5])) for _ in range(600)]
    rows += [("hot", 3, 2)] * 500
    assert measured(spark, rows) == brute(rows, 5)


def test_empty_and_all_null(spark):
    assert measured(spark, []) == {}
    assert measured(spark, [(None, 1, 1)] * 3) == {}
    assert measured(spark, [("x", None, None)] * 3) == {"x": (3, None, None, None, 0, 0, None)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 40)), st.one_of(st.none(), st.integers(-5, 5))), max_size=60), st.integers(1, 9))
def test_any_chunk_size(spark, rows, chunk):
    assert measured(spark, rows, chunk=chunk) == brute(rows, 5)


def test_rows_are_numbered_exactly(spark):
    df = spark.createDataFrame([("k%d" % (i % 3), i % 4, i) for i in range(100)], "key string, at long, id long")
    rows = number_rows(df, F.col("key"), F.col("at"), payload=["id"])
    got = rows.orderBy("row").collect()
    assert [r.row for r in got] == list(range(100))
    assert [(r.key, r["at"]) for r in got] == sorted((r.key, r["at"]) for r in got)
    assert sorted(r.id for r in got) == list(range(100))
    starts = {r.key: (r.start, r.n) for r in key_starts(rows).collect()}
    assert starts == {"k0": (0, 34), "k1": (34, 33), "k2": (67, 33)}


def test_heavy_keys_compare_as_keys_and_count_null_rows(spark):
    df = spark.createDataFrame([(" Hot\t",)] * 6 + [("hot",)] * 4 + [("cold",)] * 3 + [(None,)] * 5 + [("  ",)] * 2, "k string")
    got = {tuple(r) for r in heavy_keys(df, as_key("k"), 0.2).collect()}
    assert got == {("hot", 10)}
    assert heavy_keys(df.limit(0), as_key("k"), 0.2).collect() == []
