"""Queries of graph-aware ranking, of outcomes against the graph, and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.keys import as_key
from graphloom.operators import evaluation as V
from graphloom.operators import fusion as U
from graphloom.operators import retrieval as R
from graphloom.operators import signals as G
from graphloom.plans import retrieval as P
from graphloom.plans import training
from graphloom.session import cut, new_folder
from graphloom.sources.tables import table
from graphloom.streaming import materializer
from graphloom.streaming.search_index import refresh_postings

SALIENT = "friend family work school travel health music book project plan meeting record found made".split()


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return R.graph_features(P._edges(spark, sf))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return G.memory_signals(_features(spark, sf), P._edges(spark, sf))


def memory_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf)


def memory_salience(spark: SparkSession, sf: str) -> DataFrame:
    return G.salience(P.memories(spark, sf), _signals(spark, sf), SALIENT)


def rank_graph_native(spark: SparkSession, sf: str) -> DataFrame:
    edges = P._edges(spark, sf)
    return R.top_k(G.graph_native(P.view_queries(spark, sf), _features(spark, sf), edges, _signals(spark, sf)), 10)


def rank_selective(spark: SparkSession, sf: str) -> DataFrame:
    """BM25's first 50 with the more salient half in front."""
    return G.selective(R.top_k(P._bm25(spark, sf), P.DEPTH), memory_salience(spark, sf), 50)


def rank_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal ranks plus 0.005 for edges plus 0.002 for temporal edges where the query is temporal."""
    a, b = P._lists(spark, sf)
    fused = U.reciprocal_rank([(a, 1.0), (b, 1.0)], 60.0)
    signals = _signals(spark, sf).select("doc_id", F.lit(1).alias("_kg"), "temporal")
    timed = P.view_queries(spark, sf).select("query_id", X.is_temporal(X.tokens(F.col("text"))).cast("int").alias("_timed"))
    rows = fused.join(signals, "doc_id", "left").join(timed, "query_id")
    score = F.col("score") + 0.005 * F.coalesce("_kg", F.lit(0)) + 0.002 * F.coalesce(F.col("temporal") * F.col("_timed"), F.lit(0))
    return R.top_k(rows.select("query_id", "doc_id", score.alias("score")), 10, 8)


def eval_recall_depths(spark: SparkSession, sf: str) -> DataFrame:
    """How often BM25 lists the gold memory among its first 1, 10, 50, 100 and 200."""
    ranking = R.top_k(P._bm25(spark, sf), 200)
    best = ranking.join(P._gold(spark, sf), ["query_id", "doc_id"]).select("query_id", "rank")
    rows = P._listing(spark, sf).join(best, "query_id", "left").select("rank", F.explode(F.array(*map(F.lit, (1, 10, 50, 100, 200)))).alias("depth"))
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce((F.col("rank") <= F.col("depth")).cast("int"), F.lit(0))), 6).alias("hit"))


def eval_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's outcome under TF-IDF and the graph rerank, by graph."""
    of = lambda ranking: V.per_query(P._listing(spark, sf), ranking, P._gold(spark, sf))
    a = of(P.rank_tfidf_sublinear_scoped(spark, sf)).select("query_id", "category", F.col("hit10").alias("a"))
    b = of(P.rank_graph_rerank(spark, sf)).select("query_id", F.col("hit10").alias("b"))
    outcome = F.when((F.col("a") == 1) & (F.col("b") == 1), "both_hit").when(F.col("b") == 1, "rescue").when(F.col("a") == 1, "hurt").otherwise("both_miss")
    return a.join(b, "query_id").groupBy("category", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def eval_graph_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How often gold memories and the others of their graph have edges, and the odds ratio."""
    flags = P._edges(spark, sf).select("doc_id").distinct().withColumn("_f", F.lit(1))
    gold = P._gold(spark, sf).select("doc_id").distinct().withColumn("_g", F.lit(1))
    rows = P.memories(spark, sf).join(flags, "doc_id", "left").join(gold, "doc_id", "left")
    f = F.coalesce("_f", F.lit(0))
    out = rows.groupBy("scope").agg(F.avg(F.when(F.col("_g") == 1, f)).alias("p"), F.avg(F.when(F.col("_g").isNull(), f)).alias("q"))
    p, q = F.col("p"), F.col("q")
    odds = F.when((p < 1) & (q < 1) & (q > 0), (p / (1 - p)) / (q / (1 - q)))
    return out.select("scope", F.round("p", 6).alias("gold_share"), F.round("q", 6).alias("other_share"), F.round(odds, 4).alias("odds_ratio"))


def eval_rerank_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and mean reciprocal rank of the graph rerank for depths 10, 20, 50 and weights 0.1, 0.3, 0.5, all in one plan."""
    base = R.top_k(P._bm25(spark, sf), 50)
    depths = base.select("*", F.explode(F.array(*map(F.lit, (10, 20, 50)))).alias("depth")).where("rank <= depth")
    tag = lambda *c: F.concat_ws("@", *c, "query_id")
    lists = depths.select(tag(F.col("depth").cast("string")).alias("query_id"), "rank", "doc_id", "score")
    kg = P._kg(spark, sf).select("query_id", "doc_id", "kg_score").select(F.explode(F.array(*map(F.lit, ("10", "20", "50")))).alias("d"), "query_id", "doc_id", "kg_score").select(tag("d").alias("query_id"), "doc_id", "kg_score")
    scored = None
    for weight in (0.1, 0.3, 0.5):
        part = U.reranked(lists, kg, weight).select(F.concat_ws("@", F.lit(str(weight)), "query_id").alias("query_id"), "doc_id", "score")
        scored = part if scored is None else scored.unionByName(part)
    cells = F.explode(F.array(*[F.lit(f"{w}@{d}") for w in (0.1, 0.3, 0.5) for d in (10, 20, 50)]))
    queries = P._listing(spark, sf).select("query_id", cells.alias("category")).select(F.concat_ws("@", "category", "query_id").alias("query_id"), "category")
    gold = queries.select("query_id", F.substring_index("query_id", "@", -1).alias("doc_id"))
    return V.summary(V.per_query(queries, R.top_k(scored, 10), gold)).where("overall = 0").drop("overall").withColumnRenamed("category", "cell")


def eval_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """For how many queries two BM25 variants list different memories, or the same in another order."""
    listed = lambda r, name: r.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    both = listed(P.rank_bm25_scoped(spark, sf), "a").join(listed(P.rank_bm25_tokens(spark, sf), "b"), "query_id", "full")
    other_set = ~F.array_sort("a").eqNullSafe(F.array_sort("b"))
    return both.agg(F.count(F.lit(1)).alias("n_queries"), F.sum(other_set.cast("bigint")).alias("other_memories"), F.sum((~other_set & ~F.col("a").eqNullSafe(F.col("b"))).cast("bigint")).alias("other_order"))


def text_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of every query over its BM25 list, as length and hash."""
    questions = P.view_queries(spark, sf).select("query_id", X.raw_part(F.col("text")).alias("question"))
    rows = G.prompts(questions, P.rank_bm25_scoped(spark, sf), P.memories(spark, sf).select("doc_id", "text"))
    return rows.select("query_id", F.length("prompt").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


FEED_FILES, FILES_A_BATCH = 8, 2


def _feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream of files, written in parts in the order of arrival and read a few at a time."""
    rows = table(spark, sf, "materialized")
    parts = new_folder(spark, "feed")
    rows.withColumn("_arrival", F.monotonically_increasing_id()).repartitionByRange(FEED_FILES, "_arrival").drop("_arrival").write.parquet(parts)
    return materializer.read_feed(spark, parts, rows.schema, FILES_A_BATCH)


def _now(spark: SparkSession, folder: str) -> DataFrame:
    return materializer.current(spark, folder).select(F.col("key").alias("memory_id"), F.col("version").cast("int").alias("version"), "update_id")


def feed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The feed applied as a stream in several batches: the memories that exist at its end."""
    folder = new_folder(spark, "stream")
    materializer.materialize(_feed_files(spark, sf), folder, folder + "/checkpoint")
    return _now(spark, folder)


def feed_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The same strictly by sequence: what exists when the first gap blocks the feed."""
    folder = new_folder(spark, "ordered")
    materializer.materialize_in_order(_feed_files(spark, sf), folder, folder + "/checkpoint")
    return _now(spark, folder)


def feed_restart(spark: SparkSession, sf: str) -> DataFrame:
    """The feed stopped after the first half of its sequences, and restarted when the rest has come: what exists before and after."""
    rows = table(spark, sf, "materialized")
    middle = rows.agg(F.floor((F.min("sequence") + F.max("sequence")) / 2).alias("_middle"))
    rows = rows.join(F.broadcast(middle)).withColumn("_late", F.coalesce(F.col("sequence") > F.col("_middle"), F.lit(True))).drop("_middle")
    folder = new_folder(spark, "restart")
    schema = table(spark, sf, "materialized").schema
    states = None
    for phase, late in (("stopped", False), ("recovered", True)):
        rows.where(F.col("_late") == late).drop("_late").write.mode("append").parquet(folder + "/feed")
        materializer.materialize(materializer.read_feed(spark, folder + "/feed", schema, 8), folder, folder + "/checkpoint")
        part = cut(_now(spark, folder), phase).agg(F.count(F.lit(1)).alias("n_memories"), F.sum("version").alias("versions"), F.countDistinct("update_id").alias("n_changes")).withColumn("phase", F.lit(phase))
        states = part if states is None else states.unionByName(part)
    return states


def feed_search_index(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the first version of each memory, kept up with its last one or its deletion: terms and texts by graph."""
    rows = table(spark, sf, "memory_by_id").where(as_key("memory_id").isNotNull())
    image = F.struct("version", "updated_at", F.col("raw_text").alias("text"))
    ends = rows.groupBy(F.col("graph_id").alias("scope"), P._ident().alias("doc_id")).agg(F.min(image).alias("a"), F.max(image).alias("z"), F.max(F.col("deleted_at").isNotNull()).alias("deleted"))
    ends = cut(ends, "memories")
    index = cut(R.postings(ends.select("scope", "doc_id", "a.text"), X.tokens), "postings")
    changed = ends.where("deleted or not (a.text <=> z.text)").select("scope", "doc_id", "z.text", "deleted")
    now = refresh_postings(index, changed)
    return now.groupBy("scope").agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("n_terms"))


QUERIES = {
    f.__name__: f
    for f in (memory_signals, memory_salience, rank_graph_native, rank_selective, rank_hybrid, eval_recall_depths, eval_outcomes, eval_graph_coverage, eval_rerank_grid, eval_alignment, text_prompts, feed_stream, feed_in_order, feed_restart, feed_search_index)
}


def _anchor(t: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in [*G.RELATION_WORDS, *X.TEMPORAL_WORDS]) + "]"
    return f"({P._ENTITY_LIKE.format(t)} AND NOT list_contains({words}, {t}))"


_SIGNALS = f"""{P._FEATURES},
sig AS (SELECT c.scope, c.doc_id, c.n_edges, CAST(coalesce(t.n_anchors, 0) AS BIGINT) AS n_anchors, coalesce(t.temporal, 0) AS temporal
  FROM (SELECT scope, doc_id, count(*) AS n_edges FROM edges GROUP BY ALL) c LEFT JOIN
  (SELECT scope, doc_id, sum(CASE WHEN {_anchor("token")} THEN is_entity ELSE 0 END) AS n_anchors, max(CAST(list_contains({P._TIMES}, token) AS INTEGER)) AS temporal FROM feat GROUP BY ALL) t ON t.scope = c.scope AND t.doc_id = c.doc_id)"""
_SALIENCE = f"""{_SIGNALS},
sal AS (SELECT m.scope, m.doc_id, round(least(3.0, CAST(s.n_edges IS NOT NULL AS INTEGER) + 0.5 * coalesce(s.temporal, 0) + 0.5 * CAST(coalesce(s.n_anchors, 0) >= 2 AS INTEGER) + 0.8 * CAST(list_has_any({P._tokens_sql("m.text")}, {SALIENT}) AS INTEGER) + 0.3 * CAST(coalesce(s.n_anchors, 0) >= 3 AS INTEGER)), 6)::DOUBLE AS salience
  FROM mem m LEFT JOIN sig s ON s.scope = m.scope AND s.doc_id = m.doc_id)"""
_RELATIONS = "[" + ", ".join(f"'{w}'" for w in G.RELATION_WORDS) + "]"
_DEPTHS = "[1, 10, 50, 100, 200]"

SQL = {
    "memory_signals": f"{P._BASE},\n{_SIGNALS}\nSELECT * FROM sig",
    "memory_salience": f"{P._BASE},\n{_SALIENCE}\nSELECT * FROM sal",
    "rank_graph_native": f"""{P._BASE},
{_SIGNALS},
qt AS (SELECT scope, query_id, list_distinct({P._tokens_sql("text")}) AS t FROM q),
qx AS (SELECT scope, query_id, len(list_filter(t, lambda x: {_anchor("x")})) AS na, len(list_filter(t, lambda x: list_contains({_RELATIONS}, x))) AS nr, list_has_any(t, {P._TIMES}) AS timed, unnest(t) AS token FROM qt),
met AS (SELECT x.scope, x.query_id, f.doc_id, na, nr, timed, CASE WHEN {_anchor("x.token")} THEN is_entity ELSE 0 END AS ea, CASE WHEN list_contains({_RELATIONS}, x.token) THEN is_relation ELSE 0 END AS er FROM qx x JOIN feat f ON f.scope = x.scope AND f.token = x.token),
edge1 AS (SELECT scope, lower(src_id) AS token, lower(dst_id) AS other FROM edges WHERE regexp_full_match(lower(src_id), '[a-z0-9]{{2,}}') AND regexp_full_match(lower(dst_id), '[a-z0-9]{{2,}}')),
near1 AS (SELECT * FROM edge1 UNION SELECT scope, other, token FROM edge1),
hop1 AS (SELECT DISTINCT x.scope, x.query_id, f.doc_id, na, nr, timed, 0 AS ea, 0 AS er FROM qx x JOIN near1 n ON n.scope = x.scope AND n.token = x.token JOIN feat f ON f.scope = x.scope AND f.token = n.other AND f.is_entity = 1 WHERE {_anchor("x.token")}),
g AS (SELECT scope, query_id, doc_id, na, nr, timed, sum(ea) AS ea, sum(er) AS er FROM (SELECT * FROM met WHERE ea + er > 0 UNION ALL SELECT * FROM hop1) GROUP BY ALL),
native AS (SELECT g.query_id, g.doc_id, 2.0 * coalesce(CAST(ea AS DOUBLE) / nullif(na, 0), 0) + 1.5 * coalesce(CAST(er AS DOUBLE) / nullif(nr, 0), 0) + CAST(timed AND s.temporal = 1 AS INTEGER) + CAST(na >= 2 AND ea >= 2 AS INTEGER) + ln(1 + s.n_edges) - 0.3 * CASE WHEN ea > 0 THEN 1 ELSE 2 END AS score
  FROM g JOIN sig s ON s.scope = g.scope AND s.doc_id = g.doc_id)
SELECT * FROM {P._top("native", 10)}""",
    "rank_selective": f"""{P._BASE},
{P._BM},
{_SALIENCE},
base AS {P._top("bscore", P.DEPTH)},
j AS (SELECT b.query_id, b.doc_id, b.rank, coalesce(s.salience, 0) AS s FROM base b LEFT JOIN sal s ON s.doc_id = b.doc_id),
r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS r FROM j),
o AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN r <= greatest(1, floor(n * 50 / 100)) AND s > 0 THEN 0 ELSE 1 END, rank) AS INTEGER) AS rank FROM r)
SELECT query_id, rank, doc_id FROM o WHERE rank <= 10""",
    "rank_hybrid": f"""{P._LISTS},
{_SIGNALS},
fused AS (SELECT {P._IDS}, coalesce(1 / (60.0::DOUBLE + a.rank), 0) + coalesce(1 / (60.0::DOUBLE + b.rank), 0) AS score FROM {P._FULL}),
timed AS (SELECT query_id, CAST(list_has_any({P._tokens_sql("text")}, {P._TIMES}) AS INTEGER) AS t FROM q),
hybrid AS (SELECT f.query_id, f.doc_id, f.score + 0.005::DOUBLE * CAST(s.doc_id IS NOT NULL AS INTEGER) + 0.002::DOUBLE * coalesce(s.temporal * t.t, 0) AS score FROM fused f LEFT JOIN sig s ON s.doc_id = f.doc_id JOIN timed t ON t.query_id = f.query_id)
SELECT * FROM {P._top("hybrid", 10, 8)}""",
    "eval_recall_depths": f"""{P._BASE},
{P._BM},
ranked AS {P._top("bscore", 200)},
best AS (SELECT q.query_id, r.rank, unnest({_DEPTHS}) AS depth FROM q LEFT JOIN ranked r ON r.query_id = q.query_id AND r.doc_id = q.query_id)
SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n, round(avg(coalesce(CAST(rank <= depth AS INTEGER), 0)), 6) AS hit FROM best GROUP BY depth""",
    "eval_outcomes": f"""{P._BASE},
{P._BM},
{P._TF},
{P._KG},
{P._MIXED},
{P._PT},
{P._per_sql("pm", P._top("mixed", 10))}
SELECT a.category, CASE WHEN a.hit10 + b.hit10 = 2 THEN 'both_hit' WHEN b.hit10 = 1 THEN 'rescue' WHEN a.hit10 = 1 THEN 'hurt' ELSE 'both_miss' END AS outcome, count(*) AS n FROM pt a JOIN pm b ON a.query_id = b.query_id GROUP BY ALL""",
    "eval_rerank_grid": f"""{P._BASE},
{P._BM},
{P._KG},
base AS {P._top("bscore", 50)},
cells AS (SELECT w, d FROM (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS w), (SELECT unnest([10, 20, 50]) AS d)),
lists AS (SELECT b.*, d FROM base b, (SELECT unnest([10, 20, 50]) AS d) WHERE rank <= d),
norm AS (SELECT *, CASE WHEN max(score) OVER v - min(score) OVER v < 1e-9 THEN 1 ELSE (score - min(score) OVER v) / (max(score) OVER v - min(score) OVER v) END AS s FROM lists WINDOW v AS (PARTITION BY query_id, d)),
mixed AS (SELECT c.w, n.d, n.query_id, n.doc_id, round(n.s + c.w * coalesce(k.score, 0), 6) AS score FROM norm n JOIN cells c ON c.d = n.d LEFT JOIN kg k ON k.query_id = n.query_id AND k.doc_id = n.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w, d, query_id ORDER BY score DESC, doc_id) AS rank FROM mixed QUALIFY rank <= 10),
per AS (SELECT c.w, c.d, r.rank FROM q CROSS JOIN cells c LEFT JOIN ranked r ON r.w = c.w AND r.d = c.d AND r.query_id = q.query_id AND r.doc_id = q.query_id)
SELECT CAST(w AS VARCHAR) || '@' || d AS cell, count(*) AS n, round(avg(coalesce(CAST(rank <= 1 AS INTEGER), 0)), 6) AS hit1, round(avg(coalesce(CAST(rank <= 5 AS INTEGER), 0)), 6) AS hit5, round(avg(CAST(rank IS NOT NULL AS INTEGER)), 6) AS hit10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM per GROUP BY w, d""",
    "eval_alignment": f"""{P._BASE},
{P._BM},
{P._TOK},
a AS (SELECT query_id, list(doc_id ORDER BY rank) AS x FROM {P._top("bscore", 10)} GROUP BY 1), b AS (SELECT query_id, list(doc_id ORDER BY rank) AS y FROM {P._top("kscore", 10)} GROUP BY 1),
f AS (SELECT a.x, b.y, list_sort(a.x) IS DISTINCT FROM list_sort(b.y) AS o FROM a FULL JOIN b ON a.query_id = b.query_id)
SELECT count(*) AS n_queries, count(*) FILTER (WHERE o) AS other_memories, count(*) FILTER (WHERE NOT o AND x IS DISTINCT FROM y) AS other_order FROM f""",
    "eval_graph_coverage": f"""{P._BASE},
{P._EDGES},
c AS (SELECT m.scope, CAST(e.doc_id IS NOT NULL AS INTEGER) AS f, g.query_id IS NOT NULL AS gold FROM mem m LEFT JOIN (SELECT DISTINCT doc_id FROM edges) e ON e.doc_id = m.doc_id LEFT JOIN q g ON g.query_id = m.doc_id),
s AS (SELECT scope, avg(f) FILTER (WHERE gold) AS p, avg(f) FILTER (WHERE NOT gold) AS q FROM c GROUP BY scope)
SELECT scope, round(p, 6) AS gold_share, round(q, 6) AS other_share, round(CASE WHEN p < 1 AND q < 1 AND q > 0 THEN (p / (1 - p)) / (q / (1 - q)) END, 4) AS odds_ratio FROM s""",
    "text_prompts": f"""{P._BASE},
{P._BM},
ev AS (SELECT r.query_id, string_agg('[' || r.rank || '] ' || coalesce(m.text, ''), chr(10) || chr(10) ORDER BY r.rank) AS e FROM {P._top("bscore", 10)} r JOIN mem m ON m.doc_id = r.doc_id GROUP BY 1),
p AS (SELECT q.query_id, 'Answer the question using only the evidence below.' || chr(10) || 'If the evidence does not contain the answer, respond exactly with ''Cannot answer''.' || chr(10) || 'Return only the shortest answer. Do not explain.' || chr(10) || chr(10) || 'Evidence:' || chr(10)
  || coalesce(ev.e, '') || chr(10) || chr(10) || 'Question: ' || coalesce(q.text, '') || chr(10) || 'Answer:' AS prompt FROM qraw q LEFT JOIN ev ON ev.query_id = q.query_id)
SELECT query_id, CAST(length(prompt) AS INTEGER) AS n_chars, sha256(prompt) AS prompt_sha256 FROM p""",
    "feed_stream": training.SQL["p2_found"],
    "feed_in_order": training.SQL["p2_found"].replace("FROM materialized)", "FROM materialized WHERE sequence <= (SELECT min(sequence) FROM (SELECT 0 AS sequence UNION ALL SELECT sequence FROM materialized) WHERE sequence + 1 NOT IN (SELECT sequence FROM materialized WHERE sequence IS NOT NULL)))"),
    "feed_restart": " UNION ALL ".join(
        f"SELECT '{phase}' AS phase, count(*) AS n_memories, CAST(sum(version) AS BIGINT) AS versions, count(DISTINCT update_id) AS n_changes FROM ({training.SQL['p2_found'].replace('FROM materialized)', f'FROM materialized WHERE {wanted})')})"
        for phase, wanted in (("stopped", "sequence <= (SELECT floor((min(sequence) + max(sequence)) / 2) FROM materialized)"), ("recovered", "true"))
    ),
    "feed_search_index": f"""
WITH m AS (SELECT graph_id AS scope, graph_id || '/' || {P._KEY} AS doc_id, last(raw_text ORDER BY version NULLS FIRST, updated_at NULLS FIRST, raw_text NULLS FIRST) AS text FROM memory_by_id WHERE {P._KEY} IS NOT NULL GROUP BY ALL HAVING count(deleted_at) = 0),
t AS (SELECT scope, doc_id, unnest({P._tokens_sql("text")}) AS term FROM m)
SELECT scope, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_postings, count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms FROM (SELECT scope, doc_id, term, count(*) AS n FROM t GROUP BY ALL) GROUP BY scope""",
}
