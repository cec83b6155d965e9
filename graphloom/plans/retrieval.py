"""Queries of retrieval, fusion and their evaluation over the memories.

The corpus is every memory's latest text, scoped by graph. Queries are the
enriched views of every memory whose number is divisible by 50, and the gold
answer of each is the memory it was made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.keys import as_key
from graphloom.operators import evaluation as V
from graphloom.operators import fusion as U
from graphloom.operators import retrieval as R
from graphloom.sources.tables import table

DEPTH = 50


def _ident() -> F.Column:
    return F.concat(F.col("graph_id"), F.lit("/"), as_key("memory_id"))


def _latest(spark: SparkSession, sf: str, name: str, text: str) -> DataFrame:
    rows = table(spark, sf, name).where(as_key("memory_id").isNotNull()).select(F.col("graph_id").alias("scope"), _ident().alias("doc_id"), F.struct("version", "updated_at", F.col(text).alias("text")).alias("v"))
    return rows.groupBy("scope", "doc_id").agg(F.max("v").alias("v")).select("scope", "doc_id", F.col("v.text").alias("text"))


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """``(scope, doc_id, text)``: the latest text of every memory."""
    return _latest(spark, sf, "memory_by_id", "raw_text")


def view_queries(spark: SparkSession, sf: str) -> DataFrame:
    """``(scope, query_id, text)``: the latest view of every memory whose number is divisible by 50."""
    rows = _latest(spark, sf, "raw_erk_view", "text")
    return rows.where(F.regexp_extract("doc_id", r"(\d+)$", 1).try_cast("bigint") % 50 == 0).select("scope", F.col("doc_id").alias("query_id"), "text")


def _raw_queries(spark: SparkSession, sf: str) -> DataFrame:
    return view_queries(spark, sf).withColumn("text", X.raw_part(F.col("text")))


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """All queries with their category (the graph) for evaluation."""
    return view_queries(spark, sf).select("query_id", F.col("scope").alias("category"))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return view_queries(spark, sf).select("query_id", F.col("query_id").alias("doc_id"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "kg_edges_by_src").where(as_key("memory_id").isNotNull())
    return rows.select(F.col("graph_id").alias("scope"), _ident().alias("doc_id"), "src_id", "relation", "dst_id")


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return R.bm25(memories(spark, sf), view_queries(spark, sf))


def rank_bm25_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(_bm25(spark, sf), 10)


def rank_bm25_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of single tokens with k1 = 1.2 and no epsilon."""
    return R.top_k(R.bm25(memories(spark, sf), view_queries(spark, sf), k1=1.2, terms=X.tokens, epsilon=0.0), 10)


def _everywhere(df: DataFrame) -> DataFrame:
    return df.withColumn("scope", F.lit("all"))


def rank_bm25_global_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The swapped BM25 variant over all graphs, its top 10 then filtered to the query's own graph."""
    top = R.top_k(R.bm25(_everywhere(memories(spark, sf)), _everywhere(view_queries(spark, sf)), swapped=True, terms=X.tokens), 10)
    graph = lambda c: F.substring_index(c, "/", 1)
    return top.where(graph("doc_id") == graph("query_id"))


def rank_tfidf_global(spark: SparkSession, sf: str) -> DataFrame:
    return R.tfidf_top(_everywhere(memories(spark, sf)), _everywhere(_raw_queries(spark, sf)), 10)


def _tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return R.tfidf(memories(spark, sf), _raw_queries(spark, sf), sublinear=True)


def rank_tfidf_sublinear_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(_tfidf(spark, sf), 10)


def _vectors(spark: SparkSession, sf: str, scope: F.Column) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", scope.alias("scope"))
    return rows, rows.where("vec_id % 50 = 0")


def rank_dense_global(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 50."""
    return R.dense(*_vectors(spark, sf, F.lit("all")), 10)


def rank_dense_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """The same among vectors of the same label."""
    return R.dense(*_vectors(spark, sf, F.col("label").cast("string")), 10)


def rank_dense_deep(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 nearest vectors of the same label."""
    return R.dense(*_vectors(spark, sf, F.col("label").cast("string")), DEPTH)


def rank_graph_boost(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF with 0.25 for memories that have edges."""
    return R.top_k(U.boosted(_tfidf(spark, sf), _edges(spark, sf), 0.25), 10)


def rank_graph_features(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct entity, relation and all tokens of the edges of each memory."""
    rows = R.graph_features(_edges(spark, sf))
    return rows.groupBy("scope", "doc_id").agg(F.sum("is_entity").alias("n_entity"), F.sum("is_relation").alias("n_relation"), F.count(F.lit(1)).alias("n_tokens"))


def _kg(spark: SparkSession, sf: str) -> DataFrame:
    return R.graph_scores(R.graph_features(_edges(spark, sf)), view_queries(spark, sf))


def rank_graph_scores(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(_kg(spark, sf).withColumnRenamed("kg_score", "score"), 10)


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return R.top_k(_tfidf(spark, sf), DEPTH), R.top_k(_bm25(spark, sf), DEPTH)


def rank_graph_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """BM25's first 50 reranked by half the query-graph score."""
    return R.top_k(U.reranked(R.top_k(_bm25(spark, sf), DEPTH), _kg(spark, sf), 0.5), 10)


def rank_graph_gated(spark: SparkSession, sf: str) -> DataFrame:
    """The same, except for queries whose BM25 list is sure of its first."""
    base = R.top_k(_bm25(spark, sf), DEPTH)
    return U.gated(base, U.reranked(base, _kg(spark, sf), 0.5))


def rank_fusion_rrf(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _lists(spark, sf)
    return R.top_k(U.reciprocal_rank([(a, 1.0), (b, 1.0)]), 10, 8)


def rank_fusion_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(U.weighted_reciprocal_rank(*_lists(spark, sf)), 10, 8)


def rank_fusion_four(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted reciprocal ranks of four sources: TF-IDF, BM25, tokens and graph."""
    a, b = _lists(spark, sf)
    return R.top_k(U.reciprocal_rank([(a, 0.4), (b, 0.3), (rank_bm25_tokens(spark, sf), 0.2), (rank_graph_scores(spark, sf), 0.1)]), 10, 8)


def rank_fusion_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(U.z_score(*_lists(spark, sf)), 10, 5)


def rank_fusion_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k(U.min_max(*_lists(spark, sf)), 10, 5)


def eval_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and mean reciprocal rank of BM25, overall and by graph."""
    return V.summary(V.per_query(_listing(spark, sf), rank_bm25_scoped(spark, sf), _gold(spark, sf)))


def eval_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return V.summary(V.per_query(_listing(spark, sf), rank_tfidf_sublinear_scoped(spark, sf), _gold(spark, sf)))


def eval_boost_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and mean reciprocal rank for three weights of the graph boost, all weights in one plan."""
    flags = _edges(spark, sf).select("scope", "doc_id").distinct().withColumn("_f", F.lit(1))
    scores = _tfidf(spark, sf).join(flags, ["scope", "doc_id"], "left")
    scores = scores.select("query_id", "doc_id", "score", F.coalesce("_f", F.lit(0)).alias("_f"), F.explode(F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(1.0))).alias("weight"))
    scores = scores.select(F.concat_ws("@", F.col("weight").cast("string"), "query_id").alias("query_id"), "doc_id", (F.col("score") + F.col("weight") * F.col("_f")).alias("score"))
    weights = F.explode(F.array(*[F.lit(w) for w in ("0.0", "0.25", "0.5", "1.0")]))
    queries = _listing(spark, sf).select("query_id", weights.alias("category")).select(F.concat_ws("@", "category", "query_id").alias("query_id"), "category")
    gold = queries.select("query_id", F.substring_index("query_id", "@", -1).alias("doc_id"))
    return V.summary(V.per_query(queries, R.top_k(scores, 10), gold)).where("overall = 0").drop("overall").withColumnRenamed("category", "weight")


def eval_rescue_hurt(spark: SparkSession, sf: str) -> DataFrame:
    """What BM25 over the enriched views rescues and hurts against TF-IDF over the raw text."""
    of = lambda ranking: V.per_query(_listing(spark, sf), ranking(spark, sf), _gold(spark, sf))
    return V.rescue_hurt(of(rank_tfidf_sublinear_scoped), of(rank_bm25_scoped))


def eval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return V.overlap(rank_tfidf_sublinear_scoped(spark, sf), rank_bm25_scoped(spark, sf))


def eval_scope_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the global TF-IDF lists that comes from other graphs."""
    graph = lambda c: F.substring_index(c, "/", 1)
    rows = rank_tfidf_global(spark, sf).select(graph("query_id").alias("graph_id"), (graph("query_id") != graph("doc_id")).cast("int").alias("leak"))
    return rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_retrieved"), F.sum("leak").alias("n_leaks"), F.round(F.avg("leak"), 6).alias("leak_share"))


def eval_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster bootstrap, by graph, of the difference in reciprocal rank between BM25 and TF-IDF."""
    of = lambda ranking: V.per_query(_listing(spark, sf), ranking(spark, sf), _gold(spark, sf))
    a, b = of(rank_tfidf_sublinear_scoped), of(rank_bm25_scoped)
    diffs = b.select("query_id", "category", F.col("rr").alias("_b")).join(a.select("query_id", F.col("rr").alias("_a")), "query_id").select("category", (F.col("_b") - F.col("_a")).alias("diff"))
    return V.paired_bootstrap(diffs, "category")


def eval_leave_graph_out(spark: SparkSession, sf: str) -> DataFrame:
    """Mean reciprocal rank of BM25 without each of the graphs."""
    return V.leave_one_out(V.per_query(_listing(spark, sf), rank_bm25_scoped(spark, sf), _gold(spark, sf)), "category", "rr")


def eval_answers(spark: SparkSession, sf: str) -> DataFrame:
    """How faithful views are to their memories, as answers: exact match, token F1, abstentions by graph."""
    views = _latest(spark, sf, "raw_erk_view", "text").select("scope", F.col("doc_id").alias("id"), X.raw_part(F.col("text")).alias("prediction"))
    rows = views.join(memories(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("gold")), "id")
    scores = V.answer_scores(rows).join(rows.select("id", "scope"), "id")
    mean = lambda c: F.round(F.avg(c), 5).alias(c)
    return scores.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), mean("em_strict"), mean("em_relaxed"), mean("f1"), mean("abstains"), mean("wrong_abstention"))


QUERIES = {
    f.__name__: f
    for f in (
        rank_bm25_scoped,
        rank_bm25_tokens,
        rank_bm25_global_filtered,
        rank_tfidf_global,
        rank_tfidf_sublinear_scoped,
        rank_dense_global,
        rank_dense_scoped,
        rank_graph_boost,
        rank_graph_features,
        rank_graph_scores,
        rank_graph_rerank,
        rank_graph_gated,
        rank_fusion_rrf,
        rank_fusion_weighted,
        rank_fusion_four,
        rank_fusion_zscore,
        rank_fusion_minmax,
        eval_bm25,
        eval_tfidf,
        eval_boost_sweep,
        eval_rescue_hurt,
        eval_overlap,
        eval_scope_leaks,
        eval_bootstrap,
        eval_leave_graph_out,
        eval_answers,
    )
}

_KEY = "nullif(lower(regexp_replace(memory_id, '^\\s+|\\s+$', '', 'g')), '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_TIMES = "[" + ", ".join(f"'{w}'" for w in X.TEMPORAL_WORDS) + "]"
_RAW = "regexp_replace({0}, '\\n(Entities|Relations|Keywords|Triples):[\\s\\S]*$', '')"


def _tokens_sql(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))"


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({_STOP}, t))"


def _latest_sql(name: str, text: str) -> str:
    return f"(SELECT graph_id AS scope, graph_id || '/' || {_KEY} AS doc_id, {text} AS text FROM {name} WHERE {_KEY} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY graph_id, {_KEY} ORDER BY version DESC NULLS LAST, updated_at DESC NULLS LAST, {text} DESC NULLS LAST) = 1)"


_BASE = f"""WITH mem AS {_latest_sql("memory_by_id", "raw_text")},
views AS {_latest_sql("raw_erk_view", "text")},
q AS (SELECT scope, doc_id AS query_id, text FROM views WHERE TRY_CAST(nullif(regexp_extract(doc_id, '(\\d+)$', 1), '') AS BIGINT) % 50 = 0),
qraw AS (SELECT scope, query_id, {_RAW.format("text")} AS text FROM q),
qall AS (SELECT 'all' AS scope, query_id, text FROM q), qrawall AS (SELECT 'all' AS scope, query_id, text FROM qraw), memall AS (SELECT 'all' AS scope, doc_id, text FROM mem)"""


def _terms_cte(name: str, source: str, ident: str, kind: str) -> str:
    if kind == "tokens":
        return f"{name} AS (SELECT scope, {ident}, {_tokens_sql('text')} AS t FROM {source})"
    return f"{name}w AS (SELECT scope, {ident}, {_words_sql('text')} AS w FROM {source}),\n{name} AS (SELECT scope, {ident}, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM {name}w)"


def _bm25_sql(n: str, corpus: str, queries: str, kind: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 1e-9, swapped: bool = False) -> str:
    relative = "p.length / s.mean_length"
    weight = f"p.tf * {k1} / (p.tf + {k1} * ({b} + {1 - b} * {relative}))" if swapped else f"p.tf * ({k1} + 1) / (p.tf + {k1} * (1 - {b} + {b} * {relative}) + {epsilon})"
    return f"""{_terms_cte(n + "d", corpus, "doc_id", kind)},
{_terms_cte(n + "q", queries, "query_id", kind)},
{n}s AS (SELECT scope, count(*) AS n_docs, avg(len(t)) AS mean_length FROM {n}d GROUP BY scope),
{n}p AS (SELECT scope, doc_id, length, term, count(*) AS tf FROM (SELECT scope, doc_id, len(t) AS length, unnest(t) AS term FROM {n}d) GROUP BY ALL),
{n}f AS (SELECT scope, term, count(*) AS df FROM {n}p GROUP BY ALL),
{n}a AS (SELECT DISTINCT scope, query_id, unnest(t) AS term FROM {n}q),
{n}score AS (SELECT p.scope, a.query_id, p.doc_id, sum(ln((s.n_docs - f.df + 0.5) / (f.df + 0.5) + 1) * {weight}) AS score
  FROM {n}p p JOIN {n}f f ON f.scope = p.scope AND f.term = p.term JOIN {n}s s ON s.scope = p.scope JOIN {n}a a ON a.scope = p.scope AND a.term = p.term GROUP BY ALL)"""


def _tfidf_sql(n: str, corpus: str, queries: str, sublinear: bool) -> str:
    damp = (lambda c: f"(1 + ln({c}))") if sublinear else (lambda c: c)
    return f"""{_terms_cte(n + "d", corpus, "doc_id", "terms")},
{_terms_cte(n + "q", queries, "query_id", "terms")},
{n}n AS (SELECT scope, count(*) AS n_docs FROM {corpus} GROUP BY scope),
{n}p AS (SELECT scope, doc_id, term, count(*) AS tf FROM (SELECT scope, doc_id, unnest(t) AS term FROM {n}d) GROUP BY ALL),
{n}i AS (SELECT scope, term, ln((1 + any_value(n_docs)) / (1 + count(*))) + 1 AS idf FROM {n}p JOIN {n}n USING (scope) GROUP BY ALL),
{n}dx AS (SELECT p.scope, p.doc_id, p.term, {damp("tf")} * idf AS w FROM {n}p p JOIN {n}i i ON i.scope = p.scope AND i.term = p.term),
{n}qx AS (SELECT a.scope, a.query_id, a.term, {damp("tf")} * idf AS w FROM (SELECT scope, query_id, term, count(*) AS tf FROM (SELECT scope, query_id, unnest(t) AS term FROM {n}q) GROUP BY ALL) a JOIN {n}i i ON i.scope = a.scope AND i.term = a.term),
{n}dn AS (SELECT scope, doc_id, sqrt(sum(w * w)) AS norm FROM {n}dx GROUP BY ALL), {n}qn AS (SELECT scope, query_id, sqrt(sum(w * w)) AS norm FROM {n}qx GROUP BY ALL),
{n}score AS (SELECT d.scope, d.query_id, d.doc_id, d.dot / (a.norm * b.norm) AS score FROM
  (SELECT x.scope, y.query_id, x.doc_id, sum(x.w * y.w) AS dot FROM {n}dx x JOIN {n}qx y ON y.scope = x.scope AND y.term = x.term GROUP BY ALL) d
  JOIN {n}dn a ON a.scope = d.scope AND a.doc_id = d.doc_id JOIN {n}qn b ON b.scope = d.scope AND b.query_id = d.query_id)"""


def _top(scores: str, k: int, digits: int = 6) -> str:
    return f"(SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM (SELECT query_id, doc_id, round(score, {digits}) AS score FROM {scores}) QUALIFY rank <= {k})"


_EDGES = f"edges AS (SELECT graph_id AS scope, graph_id || '/' || {_KEY} AS doc_id, src_id, relation, dst_id FROM kg_edges_by_src WHERE {_KEY} IS NOT NULL)"
_FEATURES = f"""{_EDGES},
feat AS (SELECT scope, doc_id, token, max(e) AS is_entity, max(r) AS is_relation FROM (
  SELECT scope, doc_id, unnest(list_concat({_tokens_sql("src_id")}, {_tokens_sql("dst_id")})) AS token, 1 AS e, 0 AS r FROM edges
  UNION ALL SELECT scope, doc_id, unnest({_tokens_sql("relation")}), 0, 1 FROM edges) GROUP BY ALL)"""
_ENTITY_LIKE = f"length({{0}}) >= 3 AND NOT regexp_full_match({{0}}, '[0-9]+') AND NOT list_contains({_STOP}, {{0}})"
_W = R.GRAPH_WEIGHTS
_KG = f"""{_FEATURES},
qt AS (SELECT scope, query_id, list_distinct({_tokens_sql("text")}) AS t FROM q),
qx AS (SELECT scope, query_id, len(t) AS n, list_has_any(t, {_TIMES}) AS temporal, len(list_filter(t, lambda x: {_ENTITY_LIKE.format("x")})) AS entities, unnest(t) AS token FROM qt),
timed AS (SELECT DISTINCT scope, doc_id, true AS is_timed FROM feat WHERE list_contains({_TIMES}, token)),
met AS (SELECT x.scope, x.query_id, f.doc_id, x.n, x.temporal, x.entities, sum(is_entity) AS e, sum(is_relation) AS r, count(*) AS a, sum(CASE WHEN {_ENTITY_LIKE.format("x.token")} THEN is_entity ELSE 0 END) AS ee
  FROM qx x JOIN feat f ON f.scope = x.scope AND f.token = x.token GROUP BY ALL),
kg AS (SELECT m.scope, m.query_id, m.doc_id, least(1.0, greatest(0.0, {_W["entity"]} * CAST(e AS DOUBLE) / n + {_W["relation"]} * CAST(r AS DOUBLE) / n + {_W["text"]} * CAST(a AS DOUBLE) / n
  + CASE WHEN temporal AND is_timed THEN {_W["temporal"]} ELSE 0 END + CASE WHEN entities >= 2 AND ee >= 2 THEN {_W["multi_entity"]} ELSE 0 END)) AS score FROM met m LEFT JOIN timed t ON t.scope = m.scope AND t.doc_id = m.doc_id)"""

_BM = _bm25_sql("b", "mem", "q", "terms")
_TOK = _bm25_sql("k", "mem", "q", "tokens", k1=1.2, epsilon=0.0)
_TF = _tfidf_sql("t", "mem", "qraw", True)
_TFALL = _tfidf_sql("g", "memall", "qrawall", False)
_LISTS = f"{_BASE},\n{_BM},\n{_TF},\nla AS {_top('tscore', DEPTH)},\nlb AS {_top('bscore', DEPTH)}"
_FULL = "la a FULL JOIN lb b ON a.query_id = b.query_id AND a.doc_id = b.doc_id"
_IDS = "coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id"


def _scaled_sql(middle: str, spread: str) -> str:
    one = lambda l: f"SELECT query_id, {middle} AS m, {spread} AS s, min(score) AS low FROM {l} GROUP BY query_id"
    side = lambda t, n: f"coalesce((coalesce({t}.score, {n}.low) - {n}.m) / {n}.s, 0)"
    return f""",
na AS ({one("la")}), nb AS ({one("lb")}),
f AS (SELECT {_IDS}, a.score AS sa, b.score AS sb FROM {_FULL}),
score AS (SELECT f.query_id, f.doc_id, 0.6 * coalesce((coalesce(f.sa, na.low) - na.m) / na.s, 0) + 0.4 * coalesce((coalesce(f.sb, nb.low) - nb.m) / nb.s, 0) AS score
  FROM f LEFT JOIN na ON na.query_id = f.query_id LEFT JOIN nb ON nb.query_id = f.query_id)
"""


def _per_sql(name: str, ranking: str) -> str:
    return f"""{name}r AS {ranking},
{name} AS (SELECT q.query_id, q.scope AS category, r.rank AS gold_rank, coalesce(CAST(r.rank <= 1 AS INTEGER), 0) AS hit1, coalesce(CAST(r.rank <= 5 AS INTEGER), 0) AS hit5, CAST(r.rank IS NOT NULL AS INTEGER) AS hit10, coalesce(1.0 / r.rank, 0.0) AS rr
  FROM q LEFT JOIN {name}r r ON r.query_id = q.query_id AND r.doc_id = q.query_id)"""


_SUMMARY = "SELECT category, CAST(grouping(category) AS INTEGER) AS overall, count(*) AS n, round(avg(hit1), 6) AS hit1, round(avg(hit5), 6) AS hit5, round(avg(hit10), 6) AS hit10, round(avg(rr), 6) AS mrr FROM {0} GROUP BY CUBE (category)"
_MIXED = f"""base AS {_top("bscore", DEPTH)},
norm AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM base WINDOW w AS (PARTITION BY query_id)),
mixed AS (SELECT n.query_id, n.doc_id, n.s + 0.5 * coalesce(k.score, 0) AS score FROM norm n LEFT JOIN kg k ON k.query_id = n.query_id AND k.doc_id = n.doc_id)"""
_PB = _per_sql("pb", _top("bscore", 10))
_PT = _per_sql("pt", _top("tscore", 10))
_DENSE = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
n AS (SELECT vec_id, e, label, greatest(sqrt(list_dot_product(e, e)), 1e-30) AS norm FROM v),
score AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.e, b.e) / (a.norm * b.norm) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id AND {0} WHERE a.vec_id % 50 = 0)
SELECT * FROM """ + _top("score", 10)
_ROUND5 = ", ".join(f"round(avg({c}), 5) AS {c}" for c in ("em_strict", "em_relaxed", "f1", "abstains", "wrong_abstention"))
_STRICT = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_RELAXED = "array_to_string(list_transform(string_split({0}, ' '), lambda t: CASE t " + " ".join(f"WHEN '{w}' THEN '{i}'" for i, w in enumerate(X.NUMBER_WORDS)) + " ELSE t END), ' ')"
_ABSTAIN = "(" + " OR ".join(f"contains(pr, '{p}')" for p in X.ABSTENTIONS) + ")"

SQL = {
    "rank_bm25_scoped": f"{_BASE},\n{_BM}\nSELECT * FROM {_top('bscore', 10)}",
    "rank_bm25_tokens": f"{_BASE},\n{_TOK}\nSELECT * FROM {_top('kscore', 10)}",
    "rank_bm25_global_filtered": f"{_BASE},\n{_bm25_sql('w', 'memall', 'qall', 'tokens', swapped=True)}\nSELECT * FROM {_top('wscore', 10)} WHERE split_part(doc_id, '/', 1) = split_part(query_id, '/', 1)",
    "rank_tfidf_global": f"{_BASE},\n{_TFALL}\nSELECT * FROM {_top('gscore', 10)}",
    "rank_tfidf_sublinear_scoped": f"{_BASE},\n{_TF}\nSELECT * FROM {_top('tscore', 10)}",
    "rank_dense_global": _DENSE.format("true"),
    "rank_dense_scoped": _DENSE.format("a.label = b.label"),
    "rank_graph_boost": f"{_BASE},\n{_TF},\n{_EDGES},\nboosted AS (SELECT t.query_id, t.doc_id, t.score + 0.25 * coalesce(e.f, 0) AS score FROM tscore t LEFT JOIN (SELECT DISTINCT scope, doc_id, 1 AS f FROM edges) e ON e.scope = t.scope AND e.doc_id = t.doc_id)\nSELECT * FROM {_top('boosted', 10)}",
    "rank_graph_features": f"{_BASE},\n{_FEATURES}\nSELECT scope, doc_id, CAST(sum(is_entity) AS BIGINT) AS n_entity, CAST(sum(is_relation) AS BIGINT) AS n_relation, count(*) AS n_tokens FROM feat GROUP BY ALL",
    "rank_graph_scores": f"{_BASE},\n{_KG}\nSELECT * FROM {_top('kg', 10)}",
    "rank_graph_rerank": f"{_BASE},\n{_BM},\n{_KG},\n{_MIXED}\nSELECT * FROM {_top('mixed', 10)}",
    "rank_graph_gated": f"""{_BASE},
{_BM},
{_KG},
{_MIXED},
best AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS t, max(score) FILTER (WHERE rank = 1) - coalesce(max(score) FILTER (WHERE rank = 2), 0) AS g FROM base GROUP BY 1),
sure AS (SELECT query_id FROM best WHERE t > (SELECT quantile_cont(t, 0.75) FROM best) AND g > (SELECT quantile_cont(g, 0.75) FROM best))
SELECT query_id, rank, doc_id FROM base WHERE rank <= 10 AND query_id IN (FROM sure) UNION ALL SELECT query_id, rank, doc_id FROM {_top("mixed", 10)} WHERE query_id NOT IN (FROM sure)""",
    "rank_fusion_rrf": f"{_LISTS},\nscore AS (SELECT {_IDS}, coalesce(1 / (60.0::DOUBLE + a.rank), 0) + coalesce(1 / (60.0::DOUBLE + b.rank), 0) AS score FROM {_FULL})\nSELECT * FROM {_top('score', 10, 8)}",
    "rank_fusion_weighted": f"{_LISTS},\nscore AS (SELECT {_IDS}, 0.5::DOUBLE / (10 + coalesce(a.rank, 999)) + 0.5::DOUBLE / (10 + coalesce(b.rank, 999)) AS score FROM {_FULL})\nSELECT * FROM {_top('score', 10, 8)}",
    "rank_fusion_four": f"""{_LISTS},
{_TOK},
{_KG},
score AS (SELECT query_id, doc_id, sum(s) AS score FROM (
  SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) AS s FROM la UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM lb
  UNION ALL SELECT query_id, doc_id, 0.2::DOUBLE / (60 + rank) FROM {_top("kscore", 10)} UNION ALL SELECT query_id, doc_id, 0.1::DOUBLE / (60 + rank) FROM {_top("kg", 10)}) GROUP BY ALL)
SELECT * FROM {_top("score", 10, 8)}""",
    "rank_fusion_zscore": f"{_LISTS}{_scaled_sql('avg(score)', 'CASE WHEN count(*) > 1 THEN greatest(stddev_samp(score), 1e-9) ELSE 1 END')}SELECT * FROM {_top('score', 10, 5)}",
    "rank_fusion_minmax": f"{_LISTS}{_scaled_sql('min(score)', 'greatest(max(score) - min(score), 1e-9)')}SELECT * FROM {_top('score', 10, 5)}",
    "eval_bm25": f"{_BASE},\n{_BM},\n{_PB}\n{_SUMMARY.format('pb')}",
    "eval_tfidf": f"{_BASE},\n{_TF},\n{_PT}\n{_SUMMARY.format('pt')}",
    "eval_boost_sweep": f"""{_BASE},
{_TF},
{_EDGES},
w AS (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS weight),
boosted AS (SELECT w.weight, t.query_id, t.doc_id, round(t.score + w.weight * coalesce(e.f, 0), 6) AS score FROM tscore t LEFT JOIN (SELECT DISTINCT scope, doc_id, 1 AS f FROM edges) e ON e.scope = t.scope AND e.doc_id = t.doc_id, w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, doc_id) AS rank FROM boosted QUALIFY rank <= 10),
per AS (SELECT w.weight, r.rank FROM q CROSS JOIN w LEFT JOIN ranked r ON r.weight = w.weight AND r.query_id = q.query_id AND r.doc_id = q.query_id)
SELECT CAST(weight AS VARCHAR) AS weight, count(*) AS n, round(avg(coalesce(CAST(rank <= 1 AS INTEGER), 0)), 6) AS hit1, round(avg(coalesce(CAST(rank <= 5 AS INTEGER), 0)), 6) AS hit5, round(avg(CAST(rank IS NOT NULL AS INTEGER)), 6) AS hit10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM per GROUP BY weight""",
    "eval_rescue_hurt": f"""{_BASE},
{_BM},
{_TF},
{_PB},
{_PT},
m AS (SELECT a.hit1 AS a1, a.hit10 AS a10, b.hit1 AS b1, b.hit10 AS b10, coalesce(a.gold_rank, 99) AS ra, coalesce(b.gold_rank, 99) AS rb FROM pt a JOIN pb b ON a.query_id = b.query_id)
SELECT count(*) AS n, count(*) FILTER (WHERE b1 > a1) AS rescue1, count(*) FILTER (WHERE a1 > b1) AS hurt1, count(*) FILTER (WHERE b10 > a10) AS rescue10, count(*) FILTER (WHERE a10 > b10) AS hurt10,
  count(*) FILTER (WHERE a10 + b10 = 2) AS both_hit, count(*) FILTER (WHERE a10 + b10 = 0) AS both_miss, count(*) FILTER (WHERE rb < ra AND ra < 99) AS improved, count(*) FILTER (WHERE rb = ra AND ra < 99) AS tied,
  count(*) FILTER (WHERE rb > ra AND rb < 99) AS worsened, count(*) FILTER (WHERE ra = 99 AND rb < 99) AS newly_retrieved, count(*) FILTER (WHERE rb = 99 AND ra < 99) AS dropped FROM m""",
    "eval_overlap": f"{_BASE},\n{_BM},\n{_TF},\nla AS {_top('tscore', 10)},\nlb AS {_top('bscore', 10)}\nSELECT query_id, CAST(sum(both_) AS BIGINT) AS shared, round(sum(both_) / count(*), 6) AS jaccard FROM (SELECT {_IDS}, CAST(a.rank IS NOT NULL AND b.rank IS NOT NULL AS INTEGER) AS both_ FROM {_FULL}) GROUP BY query_id",
    "eval_scope_leaks": f"{_BASE},\n{_TFALL}\nSELECT split_part(query_id, '/', 1) AS graph_id, count(*) AS n_retrieved, CAST(sum(leak) AS BIGINT) AS n_leaks, round(avg(leak), 6) AS leak_share FROM (SELECT query_id, CAST(split_part(query_id, '/', 1) <> split_part(doc_id, '/', 1) AS INTEGER) AS leak FROM {_top('gscore', 10)}) GROUP BY 1",
    "eval_bootstrap": f"""{_BASE},
{_BM},
{_TF},
{_PB},
{_PT},
d AS (SELECT b.category, sum(b.rr - a.rr) AS s, count(*) AS n FROM pb b JOIN pt a ON a.query_id = b.query_id GROUP BY 1),
r AS (SELECT s, n, rep, CAST('0x' || substr(md5('42:' || rep || ':' || coalesce('k' || category, 'n')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM d, (SELECT unnest(range(1000)) AS rep)),
w AS (SELECT rep, sum(s * len(list_filter({list(V.POISSON)}::DOUBLE[], lambda x: u >= x))) / sum(n * len(list_filter({list(V.POISSON)}::DOUBLE[], lambda x: u >= x))) AS m FROM r GROUP BY rep HAVING sum(n * len(list_filter({list(V.POISSON)}::DOUBLE[], lambda x: u >= x))) > 0),
o AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r, count(*) OVER () AS k FROM w)
SELECT (SELECT count(*) FROM d) AS n_groups, (SELECT round(sum(s) / sum(n), 6) FROM d) AS mean_diff, round(max(m) FILTER (WHERE r = floor(k * 0.025)), 6) AS low, round(max(m) FILTER (WHERE r = floor(k * 0.975)), 6) AS high FROM o""",
    "eval_leave_graph_out": f"{_BASE},\n{_BM},\n{_PB},\ng AS (SELECT category, sum(rr) AS gs, count(*) AS gn FROM pb GROUP BY 1), w AS (SELECT sum(rr) AS s, count(*) AS n FROM pb)\nSELECT category, round((s - gs) / nullif(n - gn, 0), 6) AS mean_without, round((s - gs) / nullif(n - gn, 0) - s / n, 6) AS delta FROM g, w",
    "eval_answers": f"""{_BASE},
r AS (SELECT v.scope, v.doc_id AS id, {_STRICT.format(_RAW.format("v.text"))} AS ps, {_STRICT.format("m.text")} AS gs FROM views v JOIN mem m ON m.doc_id = v.doc_id),
x AS (SELECT *, {_RELAXED.format("ps")} AS pr, {_RELAXED.format("gs")} AS gr FROM r),
t AS (SELECT id, token, sum(p) AS p, sum(g) AS g FROM (SELECT id, unnest(string_split(pr, ' ')) AS token, 1 AS p, 0 AS g FROM x UNION ALL SELECT id, unnest(string_split(gr, ' ')), 0, 1 FROM x) WHERE token <> '' GROUP BY ALL),
s AS (SELECT id, sum(least(p, g)) AS same, sum(p) AS np, sum(g) AS ng FROM t GROUP BY id),
e AS (SELECT x.scope, CAST(ps = gs AS INTEGER) AS em_strict, CAST(pr = gr AS INTEGER) AS em_relaxed, round(CASE WHEN coalesce(np, 0) + coalesce(ng, 0) = 0 THEN 1 ELSE 2.0 * same / (np + ng) END, 6) AS f1, CAST({_ABSTAIN} AS INTEGER) AS abstains, CAST({_ABSTAIN} AND gr <> '' AS INTEGER) AS wrong_abstention FROM x LEFT JOIN s ON s.id = x.id)
SELECT scope, count(*) AS n, {_ROUND5} FROM e GROUP BY scope""",
}
