import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.relative_quantiles import RelativeSketch, merge_sketches, percentiles, sketch


def worst(values, found, fractions):
    """Rank error, relative to the distance from the protected upper end."""
    ordered = np.sort(values)
    out = []
    for f, v in zip(fractions, found):
        low, high = np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right")
        target = f * len(ordered)
        error = 0 if low <= target <= high else min(abs(low - target), abs(high - target))
        out.append(error / max(1, len(ordered) - target))
    return max(out)


def test_error_shrinks_towards_the_tail():
    rng = np.random.default_rng(5)
    fractions = [0.5, 0.9, 0.99, 0.999, 0.9999]
    for make in (rng.lognormal, rng.standard_normal):
        values = make(size=400_000)
        s = RelativeSketch()
        for part in np.array_split(values, 57):
            s.add(part)
        assert s.n == len(values)
        assert worst(values, s.quantiles(fractions), fractions) < 0.05
        assert len(s.to_bytes()) < 60_000


def test_merging_in_any_grouping():
    rng = np.random.default_rng(6)
    values = rng.lognormal(size=100_000)
    parts = []
    for part in np.array_split(values, 31):
        s = RelativeSketch()
        s.add(part)
        parts.append(RelativeSketch.from_bytes(s.to_bytes()))
    while len(parts) > 1:
        a = parts.pop(0)
        a.merge(parts.pop())
        parts.append(a)
    assert parts[0].n == len(values)
    fractions = [0.5, 0.9, 0.99, 0.999]
    assert worst(values, parts[0].quantiles(fractions), fractions) < 0.05


def test_small_and_lower_tail_are_exact():
    s = RelativeSketch()
    s.add(np.array([5.0, 1.0, 3.0]))
    assert s.quantiles([0, 0.5, 1]) == [1.0, 3.0, 5.0]
    assert np.isnan(RelativeSketch().quantiles([0.5])[0])
    low = RelativeSketch(upper=False)
    low.add(np.arange(100_000.0))
    assert abs(low.quantiles([0.0001])[0] - 10) <= 2


def test_groups_nulls_and_empty(spark):
    rows = [("a", 1, float(i)) for i in range(1000)] + [(None, 1, 7.0), ("b", None, None), ("b", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, n int, v double").repartition(5)

    merged = merge_sketches(sketch(df, {"g": F.col("g"), "m": F.col("n")}, F.col("v")), ["g", "m"])
    got = {(r.g, r.m, r.pct): r.value for r in percentiles(merged, ["g", "m"], [50, 99]).collect()}
    assert got[("a", 1, 99)] == 989.0 and abs(got[("a", 1, 50)] - 499) < 30
    assert got[(None, 1, 50)] == 7.0
    assert not any(k[0] == "b" for k in got)
    assert merge_sketches(sketch(df.limit(0), {"g": F.col("g")}, F.col("v")), ["g"]).collect() == []



def test_thousands_of_merges_stay_bounded():
    rng = np.random.default_rng(8)
    fractions = [0.5, 0.9, 0.99, 0.999]
    for parts, size in ((20_000, 300), (2_000, 3_000)):
        values = rng.lognormal(size=parts * size)
        whole = RelativeSketch()
        for i, part in enumerate(values.reshape(parts, size)):
            one = RelativeSketch(seed=i + 1)
            one.add(part)
            whole.merge(one)
        assert whole.n == parts * size
        assert worst(values, whole.quantiles(fractions), fractions) < 0.01


def test_many_columns_keep_their_groups_apart(spark):
    # the product of the sizes of five dictionaries would pass 64 bits
    columns = {f"k{i}": F.expr(f"cast(id * {2 * i + 1} as string)") for i in range(5)}
    got = merge_sketches(sketch(spark.range(10_000).repartition(1), columns, F.col("id")), list(columns))
    assert got.count() == 10_000
    assert got.where("k1 = cast(cast(k0 as long) * 3 as string) and k4 = cast(cast(k0 as long) * 9 as string) and n = 1").count() == 10_000


def test_tree_of_merges(spark):
    df = spark.range(60_000).repartition(40).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("v"))
    parts = sketch(df, {"g": F.col("g")}, F.col("v"))
    assert parts.count() == 80
    exact = {(r.g, p): v for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.99))).alias("q")).collect() for p, v in zip((50, 99), r.q)}
    for split in (1, 5, 32):
        got = {(r.g, r.pct): r for r in percentiles(merge_sketches(parts, ["g"], split), ["g"], [50, 99]).collect()}
        assert set(got) == set(exact)
        assert all(r.n == 30_000 and abs(r.value / exact[k] - 1) < 0.02 for k, r in got.items())
    assert merge_sketches(parts, []).collect()[0].n == 60_000
