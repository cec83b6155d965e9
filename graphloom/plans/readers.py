"""Queries of answers read from evidence, of choices made on development data, and of what rankings cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.keys import as_key
from graphloom.operators import evaluation as V
from graphloom.operators import evidence as J
from graphloom.operators import fusion as U
from graphloom.operators import readers as A
from graphloom.operators import retrieval as R
from graphloom.operators import signals as G
from graphloom.plans import feeds, hybrid
from graphloom.plans import retrieval as P
from graphloom.session import cut
from graphloom.sources.tables import table

# answers: the reader answers each held-out question with the text that BM25 finds first among all memories


def _answers(spark: SparkSession, sf: str, terms=X.tokens) -> DataFrame:
    """``(id, category, gold, evidence, prediction)`` of every held-out question; without evidence the reader abstains."""
    items = table(spark, sf, "heldout_items").select(F.col("item_id").cast("string").alias("id"), "category", "question", F.col("answer").alias("gold"))
    asked = items.select(F.lit("all").alias("scope"), F.col("id").alias("query_id"), F.col("question").alias("text"))
    corpus = P._everywhere(P.memories(spark, sf))
    best = R.top_k(R.bm25(corpus, asked, terms=terms), 1).join(corpus.select("doc_id", "text"), "doc_id").select(F.col("query_id").alias("id"), F.col("text").alias("evidence"))
    rows = items.join(best, "id", "left")
    return rows.select("id", "category", "gold", "evidence", F.coalesce("evidence", F.lit("Cannot answer")).alias("prediction"))


def _scored(rows: DataFrame) -> DataFrame:
    rows = cut(rows, "answers")
    scores = V.answer_scores(rows).select("id", "em_relaxed", "f1", "abstains")
    return rows.join(scores, "id")


def reader_summary(spark: SparkSession, sf: str) -> DataFrame:
    """By category: exact match, token F1, abstentions, and wrong abstentions under both definitions; in category 5 abstaining is right."""
    wrong = A.wrong_abstentions(F.col("abstains") == 1, F.col("f1"), F.col("gold"))
    rows = _scored(_answers(spark, sf)).withColumns(wrong)
    mean = lambda c: F.round(F.avg(c), 5).alias(c)
    right = F.round(F.avg(F.when(F.col("category") == 5, F.col("abstains"))), 5).alias("abstention_accuracy")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), mean("em_relaxed"), mean("f1"), mean("abstains"), *map(mean, wrong), right)


def reader_adversarial(spark: SparkSession, sf: str) -> DataFrame:
    """What the answers to each category's questions are, with the gold answer as the trap."""
    rows = _answers(spark, sf).select("category", A.adversarial_outcome(F.col("prediction"), F.col("gold")).alias("outcome"))
    return rows.groupBy("category", "outcome").agg(F.count(F.lit(1)).alias("n"))


def reader_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Token F1 of answers whose gold answer stands in the evidence, and of the others."""
    rows = _scored(_answers(spark, sf)).withColumn("in_evidence", A.answer_in_evidence(F.col("evidence"), F.col("gold")))
    return rows.groupBy("in_evidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 5).alias("f1"))


def reader_wins(spark: SparkSession, sf: str) -> DataFrame:
    """By category, on how many questions evidence found by words and pairs beats evidence found by words, by token F1."""
    a, b = _scored(_answers(spark, sf)), _scored(_answers(spark, sf, X.terms))
    return A.win_tie_loss(a, b, "id", "f1", "category")


def reader_changes(spark: SparkSession, sf: str) -> DataFrame:
    """How many answers change between the two."""
    return A.changed_share(_answers(spark, sf), _answers(spark, sf, X.terms), "id", "prediction")


def _per(spark: SparkSession, sf: str, ranking: DataFrame) -> DataFrame:
    return V.per_query(P._listing(spark, sf), ranking, P._gold(spark, sf))


def eval_rank_labels(spark: SparkSession, sf: str) -> DataFrame:
    """How often the gold memory has which rank under TF-IDF and under BM25, ranks beyond 10 and absences named."""
    best = lambda ranking, name: P._gold(spark, sf).join(ranking, ["query_id", "doc_id"], "left").select("query_id", A.rank_label(F.col("rank")).alias(name))
    a, b = P._lists(spark, sf)
    return best(a, "tfidf").join(best(b, "bm25"), "query_id").groupBy("tfidf", "bm25").agg(F.count(F.lit(1)).alias("n"))


def eval_covered(spark: SparkSession, sf: str) -> DataFrame:
    """The share of BM25's lists that has edges, and the share of lists that have edges throughout, by graph."""
    rows = A.covered_lists(P.rank_bm25_scoped(spark, sf), P._edges(spark, sf)).join(P._listing(spark, sf), "query_id")
    whole = (F.col("n") == F.col("n_covered")).cast("int")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n_lists"), F.round(F.avg("share"), 5).alias("covered"), F.round(F.avg(whole), 5).alias("all_covered"))


def eval_baseline_diff(spark: SparkSession, sf: str) -> DataFrame:
    """How far BM25 is from TF-IDF, by graph and metric, absolute and relative."""
    of = lambda ranking: V.summary(_per(spark, sf, ranking)).where("overall = 0").drop("overall")
    return A.metric_differences(of(P.rank_tfidf_sublinear_scoped(spark, sf)), of(P.rank_bm25_scoped(spark, sf)), ["category"], ["hit1", "hit10", "mrr"])


def eval_boost_best(spark: SparkSession, sf: str) -> DataFrame:
    """The weight of the graph boost with the best mean reciprocal rank, the least of equals."""
    return A.best_cell(P.eval_boost_sweep(spark, sf), [F.desc("mrr"), F.col("weight").cast("double")])


DEV = "pmod(conv(substring(md5(query_id), 1, 8), 16, 10), 3) = 0"


def eval_rerank_select(spark: SparkSession, sf: str) -> DataFrame:
    """The graph rerank's depth, weight and configuration chosen on a third of the queries, with its figures there and on the rest.

    Best is, in this order, hits at 10, reciprocal rank, hits gained less hits
    lost, and fewest lost; then the name.
    """
    base = cut(R.top_k(P._bm25(spark, sf), 50), "base")
    shares = R.graph_shares(hybrid._features(spark, sf), P.view_queries(spark, sf)).join(base.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    configs = F.explode(F.array(*[F.struct(F.lit(name).alias("config"), R.graph_score(w).alias("kg_score")) for name, w in R.GRAPH_CONFIGS.items()]))
    kg = cut(shares.select("query_id", "doc_id", configs.alias("x")).select("query_id", "doc_id", "x.*"), "scores")
    lists = base.select("*", F.explode(F.array(F.lit(20), F.lit(50))).alias("depth")).where("rank <= depth")
    scored = None
    for config in R.GRAPH_CONFIGS:
        mine = kg.where(F.col("config") == config)
        for depth in (20, 50):
            for weight in (0.1, 0.5):
                part = U.reranked(lists.where(F.col("depth") == depth), mine, weight).withColumn("cell", F.lit(f"{config}@{depth}@{weight}"))
                scored = part if scored is None else scored.unionByName(part)
    tagged = scored.select(F.concat_ws("#", "cell", "query_id").alias("query_id"), "doc_id", "score")
    gold = P._gold(spark, sf)
    ranked = R.top_k(tagged, 10).where(F.substring_index("query_id", "#", -1) == F.col("doc_id")).select(F.substring_index("query_id", "#", 1).alias("cell"), F.substring_index("query_id", "#", -1).alias("query_id"), "rank")
    before = base.where("rank <= 10").join(gold, ["query_id", "doc_id"]).select("query_id", F.lit(1).alias("was"))
    queries = P._listing(spark, sf).select("query_id", F.expr(DEV).alias("dev"))
    cells = queries.select("*", F.explode(F.array(*[F.lit(f"{c}@{d}@{w}") for c in R.GRAPH_CONFIGS for d in (20, 50) for w in (0.1, 0.5)])).alias("cell"))
    rows = cells.join(ranked, ["cell", "query_id"], "left").join(before, "query_id", "left").select("cell", "dev", F.col("rank").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"), F.coalesce("was", F.lit(0)).alias("was"))
    lost = F.sum(((F.col("was") == 1) & (F.col("hit") == 0)).cast("bigint"))
    net = F.sum(F.col("hit") - F.col("was"))
    found = cut(rows.groupBy("cell", "dev").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 6).alias("hit10"), F.round(F.avg("rr"), 6).alias("mrr"), net.alias("net"), lost.alias("lost")), "cells")
    best = A.best_cell(found.where("dev"), [F.desc("hit10"), F.desc("mrr"), F.desc("net"), F.col("lost"), F.col("cell")]).select("cell")
    return found.join(F.broadcast(best), "cell")


def eval_leave_component_out(spark: SparkSession, sf: str) -> DataFrame:
    """What the graph score's reciprocal rank loses without each of its components."""
    shares = cut(R.graph_shares(hybrid._features(spark, sf), P.view_queries(spark, sf)), "shares")
    names = ["none", "entity", "relation", "text", "temporal", "multi_entity"]
    variants = F.explode(F.array(*[F.struct(F.lit(n).alias("without"), R.graph_score({**R.GRAPH_WEIGHTS, n: 0.0}).alias("score")) for n in names]))
    rows = shares.select("query_id", "doc_id", variants.alias("x")).select(F.concat_ws("#", "x.without", "query_id").alias("query_id"), "doc_id", "x.score")
    cells = P._listing(spark, sf).select(F.explode(F.array(*map(F.lit, names))).alias("category"), "query_id").select(F.concat_ws("#", "category", "query_id").alias("query_id"), "category", F.col("query_id").alias("doc_id"))
    per = V.per_query(cells, R.top_k(rows, 10), cells.select("query_id", "doc_id"))
    means = per.groupBy("category").agg(F.round(F.avg("rr"), 6).alias("mrr"))
    whole = means.where("category = 'none'").select(F.col("mrr").alias("_whole"))
    return means.join(F.broadcast(whole)).select(F.col("category").alias("without"), "mrr", F.round(F.col("mrr") - F.col("_whole"), 6).alias("delta"))


def _graph_native(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_native(P.view_queries(spark, sf), hybrid._features(spark, sf), P._edges(spark, sf), hybrid._signals(spark, sf))


def rank_graph_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The memories that the graph alone proposes for each query, without any order."""
    return _graph_native(spark, sf).select("query_id", "doc_id").distinct()


def rank_graph_padded(spark: SparkSession, sf: str) -> DataFrame:
    """Graph-native lists filled up to 10 with further memories of the query's graph in order of id."""
    ranking = R.top_k(_graph_native(spark, sf), 10)
    # a list takes at most 10 of them and may hold 10 already
    first = J.first_of_each(P.memories(spark, sf).select("scope", "doc_id"), ["scope"], ["doc_id"], 20)
    return G.padded(ranking, P.view_queries(spark, sf).select("scope", "query_id").join(first, "scope").select("query_id", "doc_id"), 10)


def memory_temporal(spark: SparkSession, sf: str) -> DataFrame:
    """How temporal each memory is, at most 2.5: 1 for a temporal edge, 1 for a time of its own, .5 for a known session."""
    rows = table(spark, sf, "memory_by_id").where(as_key("memory_id").isNotNull()).groupBy(F.col("graph_id").alias("scope"), P._ident().alias("doc_id")).agg(F.max(F.col("created_at").isNotNull().cast("int")).alias("_time"))
    sessions = table(spark, sf, "kg_edges_by_src").where(as_key("memory_id").isNotNull() & F.col("source").rlike(r"D\d+:")).select(F.col("graph_id").alias("scope"), P._ident().alias("doc_id")).distinct().withColumn("_session", F.lit(0.5))
    timed = hybrid._signals(spark, sf).select("scope", "doc_id", "temporal")
    rows = rows.join(timed, ["scope", "doc_id"], "left").join(sessions, ["scope", "doc_id"], "left")
    score = F.coalesce("temporal", F.lit(0)) + F.col("_time") + F.coalesce("_session", F.lit(0.0))
    return rows.select("scope", "doc_id", F.least(F.lit(2.5), score.cast("double")).alias("score"))


def rank_dense_prior(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 nearest vectors of the same label reranked by 0.1 for those whose number is that of a memory with edges."""
    base = P.rank_dense_deep(spark, sf)
    number = F.regexp_extract(as_key("memory_id"), r"(\d+)$", 1).try_cast("bigint")
    known = table(spark, sf, "kg_edges_by_src").select(number.alias("doc_id")).where("doc_id is not null").distinct().withColumn("_f", F.lit(1))
    rows = base.join(known, "doc_id", "left").select("query_id", "doc_id", (F.col("score") + 0.1 * F.coalesce("_f", F.lit(0))).alias("score"))
    return R.top_k(rows, 10)


def eval_anchor_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """By graph, how many queries have entity, relation and temporal anchors and any graph candidate, and how many of each."""
    words = F.array_distinct(X.tokens(F.col("text")))
    rows = P.view_queries(spark, sf).select("scope", "query_id", words.alias("t"))
    rows = rows.select("scope", "query_id", F.size(F.filter("t", G.is_anchor)).alias("e"), F.size(F.filter("t", lambda w: w.isin(*G.RELATION_WORDS))).alias("r"), X.is_temporal(F.col("t")).cast("int").alias("timed"))
    found = rank_graph_candidates(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(found, "query_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = lambda c: F.round(F.avg((F.col(c) > 0).cast("int")), 5)
    mean = lambda c: F.round(F.avg(c), 5)
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), share("e").alias("with_entity"), share("r").alias("with_relation"), share("timed").alias("temporal"), share("c").alias("with_candidate"), mean("e").alias("entities"), mean("r").alias("relations"), mean("c").alias("candidates"))


def eval_hard_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Queries to look at: boosted lists that the graph covers, that share little with BM25's and miss the gold; then hits."""
    ranking = cut(P.rank_graph_boost(spark, sf), "boosted")
    per = _per(spark, sf, ranking).select("query_id", F.col("hit10").alias("hit"), F.col("rr").alias("f1"))
    rows = per.join(A.covered_lists(ranking, P._edges(spark, sf)).select("query_id", "n_covered"), "query_id").join(V.overlap(ranking, P.rank_bm25_scoped(spark, sf)).select("query_id", F.col("shared").alias("overlap")), "query_id")
    return A.hard_cases(rows)


def trial_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Queries a second if run one after another, and the count over the longest latency, which is no throughput."""
    rows = feeds._trials(spark, sf).groupBy("experiment", "mode", "hop").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("latency_ms").cast("decimal(20,6)")).cast("double").alias("_ms"), F.max("latency_ms").alias("_max"))
    return rows.select("experiment", "mode", "hop", "n", F.round(F.col("n") * 1000 / F.nullif(F.col("_ms"), F.lit(0.0)), 4).alias("qps"), F.round(F.col("n") * 1000 / F.nullif(F.col("_max"), F.lit(0.0)), 4).alias("n_over_longest"))


def trial_day_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Upper median and spread by elements of the daily greatest latency, by experiment, mode and hop."""
    daily = feeds._trials(spark, sf).groupBy("experiment", "mode", "hop", "run_day").agg(F.max("latency_ms").alias("ms"))
    rows = A.upper_median(daily, ["experiment", "mode", "hop"], "ms")
    return rows.select("experiment", "mode", "hop", "n", "median", F.round("iqr", 6).alias("iqr"))


def feed_last_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """What an unguarded store would hold: each memory as its last row in the order of arrival left it."""
    rows = table(spark, sf, "materialized").select(as_key("memory_id").alias("memory_id"), "version", "update_id", as_key("operation").alias("operation")).withColumn("_at", F.monotonically_increasing_id())
    last = rows.where("memory_id is not null").groupBy("memory_id").agg(F.max_by(F.struct("version", "update_id", "operation"), "_at").alias("r"))
    return last.where("not (r.operation <=> 'delete_memory')").select("memory_id", "r.version", "r.update_id")


def feed_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """At the end of each second with open changes: how many, and the age of the oldest, by graph and phase of the run.

    The first four tenths of the run are ``stable``, the next two ``outage``,
    the next three ``recovery``, the rest ``drain``. Changes never found are
    left out here.
    """
    ms = F.expr("processing_started_ns div 1000000")
    rows = table(spark, sf, "materialized").select("graph_id", ms.alias("start"), (ms + F.ceil("update_to_searchable_ms").cast("bigint")).alias("end")).where("start is not null and end is not null and end >= start")
    span = rows.agg(F.min("start").alias("_low"), F.max("end").alias("_high"))
    second = lambda c: F.floor(F.col(c) / 1000)
    rows = rows.where(second("end") > second("start")).withColumn("second", F.explode(F.sequence(second("start"), second("end") - 1)))
    open_ = rows.groupBy("graph_id", "second").agg(F.count(F.lit(1)).alias("n_open"), (F.max((F.col("second") + 1) * 1000 - F.col("start"))).alias("oldest_ms"))
    part = (F.col("second") * 1000 - F.col("_low")) * 10 / (F.col("_high") - F.col("_low"))
    phase = F.when(part < 4, "stable").when(part < 6, "outage").when(part < 9, "recovery").otherwise("drain")
    return open_.join(F.broadcast(span)).select("graph_id", "second", "n_open", "oldest_ms", phase.alias("phase"))


QUERIES = {
    f.__name__: f
    for f in (
        reader_summary,
        reader_adversarial,
        reader_evidence,
        reader_wins,
        reader_changes,
        eval_rank_labels,
        eval_covered,
        eval_baseline_diff,
        eval_boost_best,
        eval_rerank_select,
        eval_leave_component_out,
        rank_graph_candidates,
        rank_graph_padded,
        memory_temporal,
        rank_dense_prior,
        eval_anchor_coverage,
        eval_hard_cases,
        trial_throughput,
        trial_day_spread,
        feed_last_arrival,
        feed_timeline,
    )
}


def _answers_sql(n: str, kind: str) -> str:
    return f"""{P._bm25_sql(n, "memall", "asked", kind)},
{n}best AS {P._top(n + "score", 1)},
{n}_a AS (SELECT i.id, i.category, i.gold, m.text AS evidence, coalesce(m.text, 'Cannot answer') AS prediction FROM items i LEFT JOIN {n}best b ON b.query_id = i.id LEFT JOIN memall m ON m.doc_id = b.doc_id),
{n}_x AS (SELECT *, {P._RELAXED.format(P._STRICT.format("prediction"))} AS pr, {P._RELAXED.format(P._STRICT.format("gold"))} AS gr, {P._RELAXED.format(P._STRICT.format("evidence"))} AS er FROM {n}_a),
{n}_t AS (SELECT id, token, sum(p) AS p, sum(g) AS g FROM (SELECT id, unnest(string_split(pr, ' ')) AS token, 1 AS p, 0 AS g FROM {n}_x UNION ALL SELECT id, unnest(string_split(gr, ' ')), 0, 1 FROM {n}_x) WHERE token <> '' GROUP BY ALL),
{n}_s AS (SELECT id, sum(least(p, g)) AS same, sum(p) AS np, sum(g) AS ng FROM {n}_t GROUP BY id),
{n}_r AS (SELECT x.*, round(CASE WHEN coalesce(np, 0) + coalesce(ng, 0) = 0 THEN 1 ELSE 2.0 * same / (np + ng) END, 6) AS f1, CAST(pr = gr AS INTEGER) AS em_relaxed, {P._ABSTAIN} AS ab FROM {n}_x x LEFT JOIN {n}_s s ON s.id = x.id)"""


_ITEMS = f"""{P._BASE},
items AS (SELECT CAST(item_id AS VARCHAR) AS id, category, question, answer AS gold FROM heldout_items),
asked AS (SELECT 'all' AS scope, id AS query_id, question AS text FROM items)"""
_ONE = f"{_ITEMS},\n{_answers_sql('o', 'tokens')}"
_TWO = f"{_ONE},\n{_answers_sql('w', 'terms')}"
_COVERED = "cov AS (SELECT r.query_id, count(*) AS n, CAST(count(e.doc_id) AS BIGINT) AS n_covered, round(count(e.doc_id) / count(*), 6) AS share FROM ranked r LEFT JOIN (SELECT DISTINCT doc_id FROM edges) e ON e.doc_id = r.doc_id GROUP BY 1)"
_NATIVE = hybrid.SQL["rank_graph_native"].rsplit("\nSELECT * FROM", 1)[0]
_CONFIGS = "configs AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', " + ", ".join(f"{w[k]}::DOUBLE" for k in ("entity", "relation", "text", "temporal", "multi_entity")) + ")" for name, w in R.GRAPH_CONFIGS.items()) + ") t(config, we, wr, wt, wm, wx))"
_SHARES = P._KG.rsplit("\nkg AS", 1)[0].rstrip(",") + """,
shares AS (SELECT m.scope, m.query_id, m.doc_id, CAST(e AS DOUBLE) / n AS entity, CAST(r AS DOUBLE) / n AS relation, CAST(a AS DOUBLE) / n AS text, CAST(coalesce(temporal AND is_timed, false) AS INTEGER) AS temporal, CAST(entities >= 2 AND ee >= 2 AS INTEGER) AS multi_entity FROM met m LEFT JOIN timed t ON t.scope = m.scope AND t.doc_id = m.doc_id)"""
_WITHOUT = [{**R.GRAPH_WEIGHTS, name: 0.0} for name in ("none", "entity", "relation", "text", "temporal", "multi_entity")]

SQL = {
    "reader_summary": f"""{_ONE}
SELECT category, count(*) AS n, round(avg(em_relaxed), 5) AS em_relaxed, round(avg(f1), 5) AS f1, round(avg(CAST(ab AS INTEGER)), 5) AS abstains, round(avg(CAST(ab AND gr <> '' AS INTEGER)), 5) AS wrong_abstention, round(avg(CAST(ab AND gr <> '' AND f1 = 0 AS INTEGER)), 5) AS wrong_abstention_f1,
  round(avg(CASE WHEN category = 5 THEN CAST(ab AS INTEGER) END), 5) AS abstention_accuracy FROM o_r GROUP BY category""",
    "reader_adversarial": f"""{_ONE}
SELECT category, CASE WHEN ab THEN 'abstained' WHEN gr = '' THEN 'unknown' WHEN contains(pr, gr) THEN 'leaked' WHEN len(list_filter(string_split(gr, ' ')[1:3], lambda w: contains(pr, w))) > 0 THEN 'partial' ELSE 'new_fact' END AS outcome, count(*) AS n FROM o_r GROUP BY ALL""",
    "reader_evidence": f"{_ONE}\nSELECT CASE WHEN gr <> '' THEN contains(er, gr) END AS in_evidence, count(*) AS n, round(avg(f1), 5) AS f1 FROM o_r GROUP BY 1",
    "reader_wins": f"{_TWO}\nSELECT a.category, count(*) AS n, count(*) FILTER (WHERE b.f1 > a.f1) AS wins, count(*) FILTER (WHERE b.f1 = a.f1) AS ties, count(*) FILTER (WHERE b.f1 < a.f1) AS losses FROM o_r a JOIN w_r b ON a.id = b.id GROUP BY 1",
    "reader_changes": f"{_TWO}\nSELECT count(*) AS n, count(*) FILTER (WHERE a.prediction IS DISTINCT FROM b.prediction) AS n_changed, round(avg(CAST(a.prediction IS DISTINCT FROM b.prediction AS INTEGER)), 6) AS share FROM o_r a JOIN w_r b ON a.id = b.id",
    "eval_rank_labels": f"""{P._LISTS},
label AS (SELECT q.query_id, a.rank AS ra, b.rank AS rb FROM q LEFT JOIN la a ON a.query_id = q.query_id AND a.doc_id = q.query_id LEFT JOIN lb b ON b.query_id = q.query_id AND b.doc_id = q.query_id)
SELECT CASE WHEN ra IS NULL THEN 'none' WHEN ra > 10 THEN '>10' ELSE CAST(ra AS VARCHAR) END AS tfidf, CASE WHEN rb IS NULL THEN 'none' WHEN rb > 10 THEN '>10' ELSE CAST(rb AS VARCHAR) END AS bm25, count(*) AS n FROM label GROUP BY ALL""",
    "eval_covered": f"""{P._BASE},
{P._BM},
{P._EDGES},
ranked AS {P._top("bscore", 10)},
{_COVERED}
SELECT q.scope AS category, count(*) AS n_lists, round(avg(share), 5) AS covered, round(avg(CAST(n = n_covered AS INTEGER)), 5) AS all_covered FROM cov JOIN q USING (query_id) GROUP BY 1""",
    "eval_baseline_diff": f"""{P._BASE},
{P._BM},
{P._TF},
{P._PB},
{P._PT},
m AS (SELECT a.category, unnest(['hit1', 'hit10', 'mrr']) AS metric, unnest([round(avg(a.hit1), 6), round(avg(a.hit10), 6), round(avg(a.rr), 6)]) AS old, unnest([round(avg(b.hit1), 6), round(avg(b.hit10), 6), round(avg(b.rr), 6)]) AS new FROM pt a JOIN pb b ON a.query_id = b.query_id GROUP BY 1)
SELECT category, metric, old, new, round(new - old, 6) AS delta, round(CASE WHEN old <> 0 THEN (new - old) / abs(old) * 100 ELSE 0 END, 2) AS relative FROM m""",
    "eval_boost_best": f"SELECT * FROM ({P.SQL['eval_boost_sweep']}) ORDER BY mrr DESC, CAST(weight AS DOUBLE) LIMIT 1",
    "eval_rerank_select": f"""{P._BASE},
{P._BM},
{_SHARES},
{_CONFIGS},
base AS {P._top("bscore", 50)},
lists AS (SELECT b.*, d AS depth FROM base b, (SELECT unnest([20, 50]) AS d) WHERE rank <= d),
norm AS (SELECT *, CASE WHEN max(score) OVER v - min(score) OVER v < 1e-9 THEN 1 ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) END AS s FROM lists WINDOW v AS (PARTITION BY query_id, depth)),
cells AS (SELECT *, config || '@' || depth || '@' || CAST(w AS VARCHAR) AS cell FROM configs, (SELECT unnest([20, 50]) AS depth), (SELECT unnest([0.1, 0.5])::DOUBLE AS w)),
mixed AS (SELECT c.cell, n.query_id, n.doc_id, round(n.s + c.w * coalesce(least(1.0, greatest(0.0, we * k.entity + wr * k.relation + wt * k.text + wm * k.temporal + wx * k.multi_entity)), 0), 6) AS score FROM norm n JOIN cells c ON c.depth = n.depth LEFT JOIN shares k ON k.query_id = n.query_id AND k.doc_id = n.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY cell, query_id ORDER BY score DESC, doc_id) AS rank FROM mixed QUALIFY rank <= 10),
per AS (SELECT c.cell, CAST('0x' || substr(md5(q.query_id), 1, 8) AS BIGINT) % 3 = 0 AS dev, t.rank IS NOT NULL AS hit, coalesce(1.0 / t.rank, 0) AS rr, b.rank IS NOT NULL AS was FROM q CROSS JOIN cells c LEFT JOIN top t ON t.cell = c.cell AND t.query_id = q.query_id AND t.doc_id = q.query_id LEFT JOIN base b ON b.query_id = q.query_id AND b.doc_id = q.query_id AND b.rank <= 10),
f AS (SELECT cell, dev, count(*) AS n, round(avg(CAST(hit AS INTEGER)), 6) AS hit10, round(avg(rr), 6) AS mrr, CAST(sum(CAST(hit AS INTEGER) - CAST(was AS INTEGER)) AS BIGINT) AS net, count(*) FILTER (WHERE was AND NOT hit) AS lost FROM per GROUP BY ALL)
SELECT * FROM f WHERE cell = (SELECT cell FROM f WHERE dev ORDER BY hit10 DESC, mrr DESC, net DESC, lost, cell LIMIT 1)""",
    "eval_leave_component_out": f"""{P._BASE},
{_SHARES},
w AS (SELECT * FROM (VALUES {", ".join(f"('{name}', " + ", ".join(f"{w[k]}::DOUBLE" for k in ("entity", "relation", "text", "temporal", "multi_entity")) + ")" for name, w in zip(("none", "entity", "relation", "text", "temporal", "multi_entity"), _WITHOUT))}) t(without, we, wr, wt, wm, wx)),
s AS (SELECT w.without, query_id, doc_id, round(least(1.0, greatest(0.0, we * entity + wr * relation + wt * text + wm * temporal + wx * multi_entity)), 6) AS score FROM shares, w),
r AS (SELECT *, row_number() OVER (PARTITION BY without, query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10),
m AS (SELECT w.without, round(avg(coalesce(1.0 / r.rank, 0)), 6) AS mrr FROM q CROSS JOIN w LEFT JOIN r ON r.without = w.without AND r.query_id = q.query_id AND r.doc_id = q.query_id GROUP BY 1)
SELECT without, mrr, round(mrr - (SELECT mrr FROM m WHERE without = 'none'), 6) AS delta FROM m""",
    "rank_graph_candidates": f"{_NATIVE}\nSELECT DISTINCT query_id, doc_id FROM native",
    "rank_graph_padded": f"""{_NATIVE},
nr AS {P._top("native", 10)},
c AS (SELECT query_id, doc_id, rank FROM nr UNION ALL SELECT q.query_id, m.doc_id, NULL FROM q JOIN mem m ON m.scope = q.scope ANTI JOIN nr ON nr.query_id = q.query_id AND nr.doc_id = m.doc_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, doc_id) AS INTEGER) AS rank, doc_id FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, doc_id) <= 10""",
    "memory_temporal": f"""{P._BASE},
{hybrid._SIGNALS},
m AS (SELECT graph_id AS scope, graph_id || '/' || {P._KEY} AS doc_id, max(CAST(created_at IS NOT NULL AS INTEGER)) AS t FROM memory_by_id WHERE {P._KEY} IS NOT NULL GROUP BY ALL),
ses AS (SELECT DISTINCT graph_id AS scope, graph_id || '/' || {P._KEY} AS doc_id FROM kg_edges_by_src WHERE {P._KEY} IS NOT NULL AND regexp_matches(source, 'D\\d+:'))
SELECT m.scope, m.doc_id, least(2.5, coalesce(s.temporal, 0) + m.t + CASE WHEN x.doc_id IS NOT NULL THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM m LEFT JOIN sig s ON s.scope = m.scope AND s.doc_id = m.doc_id LEFT JOIN ses x ON x.scope IS NOT DISTINCT FROM m.scope AND x.doc_id = m.doc_id""",
    "rank_dense_prior": P._DENSE.format("a.label = b.label").replace("SELECT * FROM " + P._top("score", 10), f""", deep AS {P._top("score", 50)},
known AS (SELECT DISTINCT TRY_CAST(nullif(regexp_extract({P._KEY}, '(\\d+)$', 1), '') AS BIGINT) AS doc_id FROM kg_edges_by_src),
pr AS (SELECT d.query_id, d.doc_id, d.score + 0.1 * CAST(k.doc_id IS NOT NULL AS INTEGER) AS score FROM deep d LEFT JOIN known k ON k.doc_id = d.doc_id)
SELECT * FROM {P._top("pr", 10)}"""),
    "eval_anchor_coverage": f"""{_NATIVE},
can AS (SELECT query_id, count(DISTINCT doc_id) AS c FROM native GROUP BY 1),
z AS (SELECT qt.scope, qt.query_id, len(list_filter(t, lambda x: {hybrid._anchor("x")})) AS e, len(list_filter(t, lambda x: list_contains({hybrid._RELATIONS}, x))) AS r, CAST(list_has_any(t, {P._TIMES}) AS INTEGER) AS timed, coalesce(can.c, 0) AS c FROM qt LEFT JOIN can ON can.query_id = qt.query_id)
SELECT scope, count(*) AS n, round(avg(CAST(e > 0 AS INTEGER)), 5) AS with_entity, round(avg(CAST(r > 0 AS INTEGER)), 5) AS with_relation, round(avg(timed), 5) AS temporal, round(avg(CAST(c > 0 AS INTEGER)), 5) AS with_candidate, round(avg(e), 5) AS entities, round(avg(r), 5) AS relations, round(avg(c), 5) AS candidates FROM z GROUP BY scope""",
    "eval_hard_cases": f"""{P._BASE},
{P._BM},
{P._TF},
{P._EDGES},
boosted AS (SELECT t.query_id, t.doc_id, t.score + 0.25 * coalesce(e.f, 0) AS score FROM tscore t LEFT JOIN (SELECT DISTINCT scope, doc_id, 1 AS f FROM edges) e ON e.scope = t.scope AND e.doc_id = t.doc_id),
ranked AS {P._top("boosted", 10)},
{_COVERED},
lb AS {P._top("bscore", 10)},
j AS (SELECT c.query_id, c.n_covered, coalesce(g.rank IS NOT NULL, false) AS hit, coalesce(1.0 / g.rank, 0) AS f1, (SELECT count(*) FROM ranked r JOIN lb ON lb.query_id = r.query_id AND lb.doc_id = r.doc_id WHERE r.query_id = c.query_id) AS overlap FROM cov c JOIN q ON q.query_id = c.query_id LEFT JOIN ranked g ON g.query_id = c.query_id AND g.doc_id = c.query_id),
h AS (SELECT query_id FROM j WHERE n_covered >= 9 AND overlap <= 3 AND f1 <= 0.1 ORDER BY 1 LIMIT 20), x AS (SELECT query_id FROM j WHERE hit AND query_id NOT IN (FROM h) ORDER BY 1 LIMIT 20)
SELECT query_id, 'hard' AS reason FROM h UNION ALL SELECT query_id, 'hit' FROM x""",
    "trial_throughput": f"WITH {feeds._TRIALS} SELECT experiment, mode, hop, count(*) AS n, round(count(*) * 1000 / CAST(sum(CAST(latency_ms AS DECIMAL(20,6))) AS DOUBLE), 4) AS qps, round(count(*) * 1000 / max(latency_ms), 4) AS n_over_longest FROM t GROUP BY ALL",
    "trial_day_spread": f"WITH {feeds._TRIALS}, d AS (SELECT experiment, mode, hop, max(latency_ms) AS ms FROM t GROUP BY experiment, mode, hop, run_day), l AS (SELECT experiment, mode, hop, list_sort(list(ms)) AS v FROM d GROUP BY ALL) SELECT experiment, mode, hop, CAST(len(v) AS BIGINT) AS n, v[len(v) // 2 + 1] AS median, round(v[len(v) * 3 // 4 + 1] - v[len(v) // 4 + 1], 6) AS iqr FROM l",
    "feed_last_arrival": f"WITH r AS (SELECT {P._KEY} AS memory_id, version, update_id, nullif(lower(regexp_replace(operation, '^\\s+|\\s+$', '', 'g')), '') AS operation, row_number() OVER () AS nr FROM materialized), l AS (SELECT * FROM r WHERE memory_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY nr DESC) = 1) SELECT memory_id, version, update_id FROM l WHERE operation IS DISTINCT FROM 'delete_memory'",
    "feed_timeline": """WITH r AS (SELECT graph_id, processing_started_ns // 1000000 AS s, processing_started_ns // 1000000 + CAST(ceil(update_to_searchable_ms) AS BIGINT) AS e FROM materialized WHERE processing_started_ns IS NOT NULL AND update_to_searchable_ms >= 0),
k AS (SELECT min(s) AS low, max(e) AS high FROM r), o AS (SELECT graph_id, s, unnest(range(s // 1000, e // 1000)) AS second FROM r),
g AS (SELECT graph_id, second, count(*) AS n_open, max((second + 1) * 1000 - s) AS oldest_ms FROM o GROUP BY ALL)
SELECT graph_id, second, n_open, oldest_ms, CASE WHEN (second * 1000 - low) * 10 / (high - low) < 4 THEN 'stable' WHEN (second * 1000 - low) * 10 / (high - low) < 6 THEN 'outage' WHEN (second * 1000 - low) * 10 / (high - low) < 9 THEN 'recovery' ELSE 'drain' END AS phase FROM g, k""",
}
