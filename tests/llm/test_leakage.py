import random

from pyspark.sql import functions as F

from graphloom.llm import leakage
from graphloom.llm.leakage import find_leaks, item_windows, signatures, size_partition

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items, run=13):
    out = {}
    for d, text in docs:
        t = (text or "").split()
        for i, passage in items:
            p = (passage or "").split()
            n = min(run, len(p))
            if not n:
                continue
            have = {tuple(t[j : j + n]) for j in range(len(t) - n + 1)}
            windows = {tuple(p[j : j + n]) for j in range(len(p) - n + 1)}
            if have & windows:
                out[d, i] = (len(have & windows), len(windows))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, 1) for r in docs], "doc_id long, text string, id long, minhash long").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, passage string, size int")
    return {(r.doc_id, r.item_id): (r.shared_windows, r.item_windows) for r in find_leaks(d, i).collect()}


def test_against_brute_force(spark):
    random.seed(4)
    items = [(k, " ".join(random.choices(WORDS, k=random.choice([0, 1, 3, 4, 5, 7, 12, 13, 14, 40, 120])))) for k in range(40)] + [(99, None)]
    docs = []
    for d in range(150):
        parts = random.choices(WORDS, k=random.randint(0, 200))
        for _ in range(random.randint(0, 2)):
            p = random.choice(items)[1]
            if p:
                w = p.split()
                n = random.choice([len(w), 13, 12, 20])
                at = random.randint(0, max(0, len(w) - n))
                parts[random.randint(0, len(parts)) : 0] = w[at : at + n]
        docs.append((d, " ".join(parts)))
    docs += [(900, None), (901, ""), (902, " ".join(random.choices(WORDS, k=30000)) + " " + items[-2][1])]
    docs += [(1000 + k, docs[3][1]) for k in range(5)]
    expected = brute(docs, items)
    assert len(expected) > 50
    assert found(spark, docs, items) == expected


def test_thirteen_words_exactly_and_disguises(spark):
    passage = " ".join(f"Word{i}" for i in range(30))
    words = passage.split()
    docs = [(1, "xx " + " ".join(words[4:17]) + " yy"), (2, "xx " + " ".join(words[4:16]) + " yy"), (3, "<p>" + ",&nbsp;".join(w.upper() for w in words[:13]) + "</p>"), (4, "> " + "\n> ".join(words[10:23])), (5, " ".join(w[:2] + "­" + w[2:] for w in words[1:14])), (6, " ".join(words[4:10] + ["zz"] + words[10:20]))]
    assert set(found(spark, docs, [(7, passage)])) == {(1, 7), (3, 7), (4, 7), (5, 7)}


def test_empty_sides(spark):
    assert found(spark, [], [(1, "a b")]) == {}
    assert found(spark, [(1, "a b")], []) == {}
    assert found(spark, [(1, "a b c")], [(1, "B"), (2, "...")]) == {(1, 1): (1, 1)}


def test_partitions_and_thresholds(spark):
    ends = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 12, 13, 16, 17, 140, 2000)], "n int").select(size_partition(F.col("n"))).collect()]
    assert ends == [1, 12, 16, 16, 32, 256, 2**31 - 1]
    random.seed(6)
    items = [(k, " ".join(random.choices(WORDS, k=n))) for k, n in enumerate((5, 13, 16, 40, 120))]
    rows = {r.item_id: r for r in signatures(item_windows(spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage")).collect()}
    assert [rows[k].partition for k in range(5)] == [5, 16, 16, 64, 128] and rows[0].threshold == rows[1].signature == 1.0
    assert rows[2].threshold == rows[1].threshold == 1 / rows[2].signature and all(r.threshold <= 1 / r.signature for r in rows.values())
    # a run in common leaves at least the threshold; the whole item leaves all
    docs = [(1, items[4][1]), (2, " ".join(items[4][1].split()[50:63]))]
    got = {r.doc_id: r.estimate for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).where("item_id = 4").collect()}
    assert got[1] == 1.0 and rows[4].threshold <= got[2] < 0.2


def test_the_filter_grows_with_the_items(spark, monkeypatch):
    windows = lambda n: spark.range(n).select(F.xxhash64("id").alias("minhash"))
    assert [leakage._filter(windows(n))[1] for n in (1, 20_000)] == [16, 25]
    monkeypatch.setattr(leakage, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(leakage, "MOST_BITS", 16)
    test_against_brute_force(spark)
