import random
from collections import Counter

import numpy as np
import pytest

from graphloom.operators import evaluation as V
from graphloom.operators import extraction as T
from graphloom.operators import feeds as D
from graphloom.operators import signals as G


def test_all_queries_count(spark):
    queries = spark.createDataFrame([("q1", "a"), ("q2", "a"), ("q3", "b"), ("q4", None)], "query_id string, category string")
    rankings = spark.createDataFrame([("q1", 1, "x"), ("q1", 2, "g1"), ("q2", 1, "g2"), ("q2", 2, "g2b"), ("q3", 11, "g3")], "query_id string, rank int, doc_id string")
    gold = spark.createDataFrame([("q1", "g1"), ("q1", "g1"), ("q2", "g2"), ("q2", "g2b"), ("q3", "g3")], "query_id string, doc_id string")
    per = V.per_query(queries, rankings, gold)
    got = {r.query_id: (r.hit1, r.hit5, r.hit10, r.rr, r.gold_rank) for r in per.collect()}
    assert got == {"q1": (0, 1, 1, 0.5, 2), "q2": (1, 1, 1, 1.0, 1), "q3": (0, 0, 0, 0.0, None), "q4": (0, 0, 0, 0.0, None)}
    rows = {(r.overall, r.category): (r.n, float(r.mrr)) for r in V.summary(per).collect()}
    assert rows == {(1, None): (4, 0.375), (0, "a"): (2, 0.75), (0, "b"): (1, 0.0), (0, None): (1, 0.0)}
    moved = V.rescue_hurt(per, V.per_query(queries, rankings.limit(0), gold)).collect()[0]
    assert (moved.hurt1, moved.hurt10, moved.dropped, moved.rescue1) == (1, 2, 2, 0)


def test_token_f1_is_that_of_multisets(spark):
    answers = [("1", "red red fish", "red fish fish"), ("2", "", None), ("3", "x", ""), ("4", "The three", "3"), ("5", "no information", "blue"), ("6", "a b a", "a b a")]
    rows = {r.id: r for r in V.answer_scores(spark.createDataFrame(answers, "id string, prediction string, gold string")).collect()}
    same = sum((Counter("red red fish".split()) & Counter("red fish fish".split())).values())
    assert float(rows["1"].f1) == pytest.approx(2 * same / 6, abs=1e-6)
    assert [float(rows[i].f1) for i in "2346"] == [1.0, 0.0, 1.0, 1.0]
    assert (rows["4"].em_strict, rows["4"].em_relaxed) == (0, 1)
    assert (rows["5"].abstains, rows["5"].wrong_abstention) == (1, 1)


def test_percentile_definitions(spark):
    random.seed(3)
    values = [float(random.randint(1, 40)) for _ in range(137)]
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 7.0)], "g string, v double")
    got = {(r.g, r.pct): r for r in V.percentile_definitions(df, ["g"], "v", [50, 95, 99]).collect()}
    ordered = sorted(values)
    for p in (50, 95, 99):
        r = got[("g", p)]
        assert float(r.linear) == pytest.approx(np.percentile(values, p))
        assert r.floor == ordered[int(136 * p / 100)]
        assert r.upper == ordered[min(136, int(137 * p / 100))]
        assert r.nearest == ordered[int(136 * p / 100 + 0.5)]
        assert got[("h", p)].linear == 7.0
    assert V.percentile_definitions(df.limit(0), ["g"], "v", [50]).collect() == []
    whole = V.percentile_definitions(df, [], "v", [50], None).collect()
    assert [(r.n, r.linear) for r in whole] == [(138, float(np.percentile([*values, 7.0], 50)))]


def test_percentiles_of_a_group_spread_over_tasks(spark):
    df = spark.range(5000).selectExpr("'g' g", "id + 0.5 v").repartition(7)
    found = V.percentile_definitions(df, ["g"], "v", [99])
    # the only window runs over counts of partitions
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    assert len(windows) == 1 and "part" in windows[0] and " g#" not in windows[0]
    assert [(r.floor, r.n) for r in found.collect()] == [(4949.5, 5000)]


def test_groups_are_split_whole(spark):
    rows = spark.createDataFrame([(i, f"c{i % 7}" if i % 8 else None) for i in range(80)], "i int, c string")
    split = {(r.c, r.part) for r in V.grouped_split(rows, "i", "c", 3).collect()}
    assert len(split) == 8 and sum(part == "held_out" for _, part in split) == 3
    assert V.grouped_split(rows.limit(0), "i", "c", 3).collect() == []


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    diffs = spark.createDataFrame([(f"c{i % 40}", float(x)) for i, x in enumerate(rng.normal(0.3, 1, 2000))], "c string, diff double")
    r = V.paired_bootstrap(diffs, "c", reps=400).collect()[0]
    assert r.n_groups == 40 and r.low < r.mean_diff < r.high and 0.05 < r.high - r.low < 0.3
    assert V.paired_bootstrap(diffs.repartition(7), "c", reps=400).collect()[0] == r
    constant = V.paired_bootstrap(spark.createDataFrame([("a", 2.0), ("b", 2.0)], "c string, diff double"), "c", reps=100).collect()[0]
    assert (constant.low, constant.high) == (2.0, 2.0)


def test_effects_and_gates(spark):
    cells = spark.createDataFrame([(a, b, 10.0 + 2 * a + 3 * b + 4 * a * b) for a in (0, 1) for b in (0, 1)], "a int, b int, v double")
    assert {r.factor: float(r.effect) for r in V.main_effects(cells, ["a", "b"], "v").collect()} == {"a": 4.0, "b": 5.0}
    assert V.interactions(cells, ["a", "b"], "v").collect()[0].interaction == 4.0
    left = {r.a: float(r.mean_without) for r in V.leave_one_out(cells, "a", "v").collect()}
    assert left == {0: 15.5, 1: 11.5}
    split = V.stratified_split(spark.createDataFrame([(i, i % 3) for i in range(50)] + [(99, 7)], "i int, c int"), "i", "c").collect()
    assert Counter((r.c, r.part) for r in split) == {(0, "dev"): 3, (0, "test"): 14, (1, "dev"): 3, (1, "test"): 14, (2, "dev"): 3, (2, "test"): 13, (7, "dev"): 1}
    sample = V.balanced_sample(spark.createDataFrame([(i, i % 3) for i in range(50)], "i int, c int"), "i", "c", 10).collect()
    assert Counter(r.c for r in sample) == {0: 4, 1: 3, 2: 3}
    a, b = (spark.createDataFrame([("m", x, 0.2)], "k string, r double, s double") for x in (0.5, 0.50001))
    assert {r.metric: r.passed for r in V.tolerance_gate(a, b, ["k"], ["r", "s"]).collect()} == {"r": True, "s": True}
    assert not any(r.passed for r in V.tolerance_gate(a.limit(0), b, ["k"], ["r"]).collect())


def test_feed(spark):
    df = spark.createDataFrame([(s,) for s in (3, 1, 2, 2, 5, 6, 9, None)], "s long")
    r = D.applied_prefix(df, "s").collect()[0]
    assert (r.checkpoint, r.n_applied, r.n_waiting) == (3, 3, 3)
    assert sorted(x.missing for x in D.gap_starts(df, "s").collect()) == [4, 7]
    assert D.gap_starts(df.limit(0), "s").collect() == []
    audit = D.version_audit(spark.createDataFrame([("a", 2), ("b", 1)], "k string, version long"), {"m": spark.createDataFrame([("a", 2)], "k string, version long")}, "k")
    assert {r.k: r.passed for r in audit.collect()} == {"a": True, "b": False}


def test_extraction(spark):
    rows = [("Ann went to the old Mill Pond yesterday.",), ("She READ.",), ("blue sky over hills",), ("the of",), (None,)]
    got = [(r.relation, r.object, r.object_type) for r in T.pattern_triples(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got == [("visited", "mill_pond_yesterday", "object"), ("read", "read", "object"), ("has_memory", "blue_sky_over_hills", "object"), ("has_memory", "memory", "object")]
    turns = T.chat_turns(spark.createDataFrame([(1, "[09:00] Ann: Hi\nnoise\n[09:02] Bo: Yo\n[09:03] Ann: So"), (2, None)], "d int, t string"), "d", "t")
    near = {r.turn: (r.previous_speaker, r.next_speaker) for r in T.neighbour_turns(turns, "d").collect()}
    assert near == {0: (None, None), 2: (None, "Ann"), 3: ("Bo", None)}
    facts = spark.createDataFrame([(1, "f", ["a", "b", "a"]), (1, "g", ["z"])], "d int, fact string, words array<string>")
    said = spark.createDataFrame([(1, 4, ["a"]), (1, 5, ["b", "a"]), (1, 6, ["a", "b"])], "d int, turn int, words array<string>")
    assert [tuple(r) for r in T.best_overlap(facts, said, "d", "words").collect()] == [(1, "f", 5, 2)]
    both = T.variants(spark.createDataFrame([("r", "e", None)], "raw string, E string, K string"), "raw", ["E", "K"]).collect()
    assert [r.text for r in both] == ["r", "r\nE: e", "r", "r\nE: e"]


def test_signals(spark):
    ranking = spark.createDataFrame([("q", i, f"d{i}") for i in range(1, 7)], "query_id string, rank int, doc_id string")
    salience = spark.createDataFrame([("d5", 3.0), ("d2", 2.0), ("d1", 0.0)], "doc_id string, salience double")
    assert [r.doc_id for r in G.selective(ranking, salience, 50, 6).orderBy("rank").collect()] == ["d2", "d5", "d1", "d3", "d4", "d6"]
    more = spark.createDataFrame([("q", d) for d in ("z", "d1", "a")], "query_id string, doc_id string")
    assert [r.doc_id for r in G.padded(ranking.where("rank <= 2"), more, 4).orderBy("rank").collect()] == ["d1", "d2", "a", "z"]
    edges = spark.createDataFrame([("s", "m1", "ann", "visited", "mill"), ("s", "m2", "mill", "owns", "well")], "scope string, doc_id string, src_id string, relation string, dst_id string")
    from graphloom.operators.retrieval import graph_features

    features = graph_features(edges)
    queries = spark.createDataFrame([("s", "q", "who visited ann")], "scope string, query_id string, text string")
    got = {r.doc_id: r.score for r in G.graph_native(queries, features, edges, G.memory_signals(features, edges)).collect()}
    assert got["m1"] == pytest.approx(2 + 1.5 + np.log(2) - 0.3) and got["m2"] == pytest.approx(np.log(2) - 0.6)
