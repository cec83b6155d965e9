import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import fusion as U
from graphloom.operators import retrieval as R
from graphloom.operators import signals as G
from graphloom.plans import retrieval as P

WORDS = "river stone lamp garden night mountain paper window train coffee".split()


def corpus(spark, n=60):
    random.seed(12)
    docs = [("s%d" % (i % 2), f"d{i:02d}", " ".join(random.choices(WORDS, k=random.randint(0, 12)))) for i in range(n)] + [("s0", "null", None), ("s0", "dup1", "river river stone"), ("s0", "dup2", "river river stone")]
    queries = [("s0", "q0", "river stone river"), ("s1", "q1", "coffee in the night"), ("s0", "q2", "nothing known here"), ("s0", "q3", None)]
    return docs, queries, spark.createDataFrame([(*d, 1) for d in docs], "scope string, doc_id string, text string, length int"), spark.createDataFrame([(*q, 1) for q in queries], "scope string, query_id string, text string, tf int")


def terms(text):
    words = [w for w in (text or "").split() if w not in X.STOPWORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_bm25(spark):
    docs, queries, c, q = corpus(spark)
    got = {(r.query_id, r.doc_id): r.score for r in R.bm25(c, q).collect()}
    expected = {}
    for scope, qid, text in queries:
        mine = [(d, terms(t)) for s, d, t in docs if s == scope]
        mean = sum(len(t) for _, t in mine) / len(mine)
        for d, t in mine:
            score = 0.0
            for term in set(terms(text)):
                df = sum(term in x for _, x in mine)
                tf = t.count(term)
                if tf:
                    score += math.log((len(mine) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean) + 1e-9)
            if score:
                expected[qid, d] = score
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
    top = R.top_k(R.bm25(c, q), 3).where("query_id = 'q0'").orderBy("rank").collect()
    assert [r.rank for r in top] == [1, 2, 3]
    assert R.bm25(c.limit(0), q).collect() == [] and R.bm25(c, q.limit(0)).collect() == []


def test_tfidf(spark):
    docs, queries, c, q = corpus(spark)
    got = {(r.query_id, r.doc_id): r.score for r in R.tfidf(c, q).collect()}
    mine = [(d, terms(t)) for s, d, t in docs if s == "s0"]
    vocabulary = sorted({t for _, x in mine for t in x})
    idf = np.array([math.log((1 + len(mine)) / (1 + sum(t in x for _, x in mine))) + 1 for t in vocabulary])
    vector = lambda x: np.array([x.count(t) for t in vocabulary]) * idf
    v = vector(terms("river stone river"))
    for d, t in mine:
        w = vector(t)
        score = v @ w / np.linalg.norm(v) / np.linalg.norm(w) if w.any() else 0
        assert got.get(("q0", d), 0) == pytest.approx(score)


def test_tfidf_top_equals_the_first_of_all_scores(spark, monkeypatch):
    for name, value in (("CELL_DOCS", 16), ("CELL_QUERIES", 2), ("LEAST_DOCS", 8)):
        monkeypatch.setattr(R, name, value)
    _, _, c, q = corpus(spark, 150)
    # equal texts tie over all cells; rows without a name count, but are not ranked
    more = [("s0", f"é{i}", "river river stone") for i in range(9)] + [("s0", None, "river lamp"), (None, "lost", "river")]
    c = c.select("scope", "doc_id", "text").unionByName(spark.createDataFrame(more, "scope string, doc_id string, text string"))
    q = q.select("scope", "query_id", "text").unionByName(spark.createDataFrame([("s0", "q4", "river"), ("s1", "q5", "garden train"), ("s0", None, "lamp"), (None, "q6", "river"), ("s2", "q7", "river")], "scope string, query_id string, text string"))
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())
    for k, sublinear in ((5, False), (500, True)):
        expected = rows(R.top_k(R.tfidf(c, q, sublinear=sublinear), k))
        assert expected and rows(R.tfidf_top(c, q, k, sublinear=sublinear)) == expected
    assert R.tfidf_top(c.limit(0), q, 5).collect() == [] and R.tfidf_top(c, q.limit(0), 5).collect() == []


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_tfidf_top_joins_postings_to_very_many_terms_only(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "BROADCAST_TERMS", limit)
    monkeypatch.setattr(R, "LOT", 50)
    joined = []
    salted_join = R.salted_join
    monkeypatch.setattr(R, "salted_join", lambda *rest, **named: joined.append(1) or salted_join(*rest, **named))
    _, _, c, q = corpus(spark)
    # terms of one document, repeated there, asked for or not; scopes whose terms must not mix
    more = [("s0", "own", "river zebra zebra zebra yak"), ("s1", "own", "river yak"), ("s1", "none", "yak"), ("s0", None, "zebra"), ("0", "x", "0 river")]
    c = c.select("scope", "doc_id", "text").unionByName(spark.createDataFrame(more, "scope string, doc_id string, text string"))
    q = q.select("scope", "query_id", "text").unionByName(spark.createDataFrame([("s0", "q4", "yak river"), ("s1", "q5", "zebra night"), ("0", "q6", "river")], "scope string, query_id string, text string"))
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in df.collect())
    for sublinear in (False, True):
        found = R.tfidf_top(c, q, 4, sublinear=sublinear)
        assert len(joined) == (limit == 0)
        assert rows(found) == rows(R.top_k(R.tfidf(c, q, sublinear=sublinear), 4))
        joined.clear()


def test_cells_leave_common_terms_out_but_no_document(monkeypatch):
    rng = np.random.default_rng(8)
    n, n_queries, vocabulary = 3000, 40, 400
    zipf = 1 / np.arange(1, vocabulary + 1)
    draw = lambda m: np.unique(rng.choice(vocabulary, m, p=zipf / zipf.sum()), return_counts=True)
    docs, queries = ([draw(rng.integers(1, 12)) for _ in range(m)] for m in (n, n_queries))
    docs[7:12] = [docs[7]] * 5  # ties
    df = np.bincount(np.concatenate([d for d, _ in docs]), minlength=vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1
    flat = lambda rows: (np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows]), np.concatenate([t for t, _ in rows]), np.concatenate([c for _, c in rows]))
    dense = lambda rows: np.array([np.bincount(t, c, vocabulary) for t, c in rows]) * idf
    norms = np.linalg.norm(dense(docs), axis=1)
    query, number, tf = flat(queries)
    gone_through = []
    bincount = np.bincount
    monkeypatch.setattr(R.np, "bincount", lambda x, *rest: gone_through.append(len(x)) or bincount(x, *rest))
    got = list(zip(*R._best_of_cell((*flat(docs), n), norms, (query, number, tf * idf[number], idf[number], n_queries), 10, 6, False)))
    monkeypatch.undo()
    scores = np.floor(dense(queries) @ dense(docs).T / norms / np.linalg.norm(dense(queries), axis=1)[:, None] * 1e6 + 0.5) / 1e6
    expected = [(i, d, scores[i, d]) for i in range(n_queries) for d in np.lexsort((np.arange(n), -scores[i]))[:10] if scores[i, d] > 0]
    assert [g[:2] for g in got] == [e[:2] for e in expected] and np.allclose([g[2] for g in got], [e[2] for e in expected])
    assert sum(gone_through) < df[number].sum() * 0.8


def test_terms_find_words_once(spark):
    plan = spark.createDataFrame([("a b",)], "text string").select(X.terms(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def shared_words(spark, folder, monkeypatch):
    """600 memories of four graphs, 12 of them queries, that all share words; the list gets how many rows are ranked."""
    at = F.timestamp_seconds(F.lit(0))
    rows = spark.range(600).select(F.concat(F.lit("g"), F.col("id") % 4).alias("graph_id"), F.format_string("m%d", "id").alias("memory_id"), F.concat(F.lit("The river carries stone "), F.col("id") % 7).alias("text"), F.lit(1).alias("version"), at.alias("updated_at"))
    rows.withColumnRenamed("text", "raw_text").write.parquet(f"{folder}/memory_by_id.parquet")
    rows.write.parquet(f"{folder}/raw_erk_view.parquet")
    ranked = []
    top_k = R.top_k
    monkeypatch.setattr(R, "top_k", lambda scores, *rest: ranked.append(scores.count()) or top_k(scores, *rest))
    return ranked


def test_global_lists_rank_few_rows_of_each_cell(spark, tmp_path, monkeypatch):
    # not the 12 * 600 pairs that share a word
    ranked = shared_words(spark, tmp_path, monkeypatch)
    assert P.rank_tfidf_global(spark, str(tmp_path)).count() == 120
    assert ranked == [120]


def test_scope_leaks_count_few_rows_of_each_cell(spark, tmp_path, monkeypatch):
    ranked = shared_words(spark, tmp_path, monkeypatch)
    leaks = P.eval_scope_leaks(spark, str(tmp_path)).collect()
    assert ranked == [120] and sum(r.n_retrieved for r in leaks) == 120


def test_dense_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    vectors[5] = vectors[6] = vectors[50]
    vectors[7] = 0
    rows = [(i, vectors[i].tolist(), "ab"[i % 2]) for i in range(300)] + [(999, None, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, scope string").repartition(3)
    got = [(r.query_id, r.rank, r.doc_id) for r in R.dense(df, df.where("vec_id % 50 = 0"), 7).collect()]
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
    expected = []
    for i in range(0, 300, 50):
        others = sorted(((-round(float(unit[i] @ unit[j]), 6), j) for j in range(300) if j != i and j % 2 == i % 2))[:7]
        expected += [(i, r, j) for r, (_, j) in enumerate(others, 1)]
    assert sorted(got) == sorted(expected)


def test_one_scope_spreads_over_slices(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rng = np.random.default_rng(4)
        vectors = rng.normal(size=(200, 4))
        df = spark.createDataFrame([(i, v.tolist(), "all") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, scope string").repartition(5)
        found = R.dense(df, df.where("vec_id % 50 = 0"), 3)
        joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "slice" in line]
        assert joins and all("scope" in line for line in joins)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for i in range(0, 200, 50):
            order = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in range(200) if j != i)[:3]
            assert [r.doc_id for r in found.where(F.col("query_id") == i).orderBy("rank").collect()] == [j for _, j in order]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def ranking(spark, lists):
    rows = [(q, r, d, float(s)) for q, docs in lists.items() for r, (d, s) in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "query_id string, rank int, doc_id string, score double")


def test_fusion(spark):
    a = ranking(spark, {"q": [("x", 3), ("y", 2), ("z", 1)], "one": [("x", 5)], "flat": [("x", 1), ("y", 1)]})
    b = ranking(spark, {"q": [("z", 9), ("w", 4)], "flat": [("y", 2)]})
    get = lambda df, q="q": {r.doc_id: r.score for r in df.where(F.col("query_id") == q).collect()}
    assert get(U.reciprocal_rank([(a, 1.0), (b, 1.0)])) == pytest.approx({"x": 1 / 61, "y": 1 / 62, "z": 1 / 63 + 1 / 61, "w": 1 / 62})
    assert get(U.weighted_reciprocal_rank(a, b)) == pytest.approx({"x": 0.5 / 11 + 0.5 / 1009, "y": 0.5 / 12 + 0.5 / 1009, "z": 0.5 / 13 + 0.5 / 11, "w": 0.5 / 1009 + 0.5 / 12})
    sd = np.std([9, 4], ddof=1)
    z = get(U.z_score(a, b))
    assert z == pytest.approx({"x": 0.6 * 1 + 0.4 * (4 - 6.5) / sd, "y": 0.4 * (4 - 6.5) / sd, "z": -0.6 + 0.4 * (9 - 6.5) / sd, "w": -0.6 + 0.4 * (4 - 6.5) / sd})
    assert get(U.z_score(a, b), "one") == {"x": 0.0}
    assert get(U.min_max(a, b)) == pytest.approx({"x": 0.6, "y": 0.3, "z": 0.4, "w": 0.0})
    extra = spark.createDataFrame([("q", "z", 0.9)], "query_id string, doc_id string, kg_score double")
    assert get(U.reranked(a, extra, 1.0)) == pytest.approx({"x": 1.0, "y": 0.5, "z": 0.9})
    assert get(U.reranked(a, extra, 1.0), "flat") == {"x": 1.0, "y": 1.0}


def test_gate_keeps_sure_queries(spark):
    base = ranking(spark, {"sure": [("a", 9), ("b", 1)], "u1": [("a", 2), ("b", 1.9)], "u2": [("a", 2), ("b", 1.9)], "u3": [("a", 1), ("b", 0.9)]})
    rerank = spark.createDataFrame([(q, d, s) for q in ("sure", "u1", "u2", "u3") for d, s in (("a", 0.1), ("b", 0.9))], "query_id string, doc_id string, score double")
    got = {(r.query_id, r.rank): r.doc_id for r in U.gated(base, rerank).collect()}
    assert got[("sure", 1)] == "a" and got[("u1", 1)] == "b" and got[("u3", 1)] == "b"


def test_graph_scores(spark):
    edges = spark.createDataFrame([("s", "m1", "person:ann", "likes", "place:old_mill"), ("s", "m1", "person:ann", "likes", "place:old_mill"), ("s", "m2", "bo", "met_before", "cafe"), ("t", "m3", "ann", "likes", "x1")], "scope string, doc_id string, src_id string, relation string, dst_id string")
    queries = spark.createDataFrame([("s", "q", "when did Ann see the old mill before"), ("s", "none", "")], "scope string, query_id string, text string")
    got = {r.doc_id: r.kg_score for r in R.graph_scores(R.graph_features(edges), queries).collect()}
    # tokens of the query: ann see old mill
    assert got == pytest.approx({"m1": 0.5 * 3 / 4 + 0.15 * 3 / 4 + 0.05})


def test_graph_native_reaches_neighbours(spark):
    edge = "scope string, doc_id string, src_id string, relation string, dst_id string"
    # ann is linked to bo, bo to cafe; only single tokens are linked
    edges = spark.createDataFrame([("s", "m1", "ann", "met", "bo"), ("s", "m2", "bo", "visited", "cafe"), ("s", "m3", "place:cafe x", "near", "mill"), ("s", "m4", "dan", "saw", "eve"), ("t", "m5", "bo", "met", "dan")], edge)
    features = R.graph_features(edges)
    queries = spark.createDataFrame([("s", "q1", "Where is Ann?"), ("s", "q2", "Who visited?"), ("s", "q3", "")], "scope string, query_id string, text string")
    got = {(r.query_id, r.doc_id): r.score for r in G.graph_native(queries, features, edges, G.memory_signals(features, edges)).collect()}
    log2 = np.log1p(1)
    # m1 has the anchor; m2 has only its neighbour bo; m2 has the relation of the second question
    assert got == pytest.approx({("q1", "m1"): 2 + log2 - 0.3, ("q1", "m2"): log2 - 0.6, ("q2", "m2"): 1.5 + log2 - 0.6})


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    lit = F.lit
    assert one(X.tokens(lit("It's the Café, at 10 o'clock! x"))) == ["caf", "10", "clock"]
    assert one(X.relaxed_answer(lit("The  Three, apples & an egg."))) == "3 apples egg"
    assert one(X.abstains(lit("It is NOT mentioned."))) is True
    assert one(X.iso_date(lit("1:56 pm on 8 May, 2023"))) == "2023-05-08" and one(X.iso_date(lit("in 1999"))) == "1999" and one(X.iso_date(lit("soon"))) is None
    assert one(X.evidence_ids(lit("D1:03, D 2 : 4; x"))) == ["D1:3", "D2:4"]
    assert one(X.split_ids(lit("a; b,a|"))) == ["a", "b"] and one(X.split_ids(lit('["x", "y"]'))) == ["x", "y"]
    assert one(X.clean_id(lit(" Some LONG text of more than eight words in all "))) == "some_long_text_of_more_than_eight_words"
    assert one(X.sentences(lit("Too short. This one is long enough to stay! And this is another of them?"))) == ["This one is long enough to stay!", "And this is another of them?"]
    assert one(X.enrichment(lit("raw\nEntities: A, B\nKeywords: c"), "Entities")) == "A, B" and one(X.raw_part(lit("raw\nEntities: A"))) == "raw"
