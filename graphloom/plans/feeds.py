"""Queries of update feeds, trials and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.keys import as_key, utc_day
from graphloom.operators import evaluation as V
from graphloom.operators import extraction as T
from graphloom.operators import feeds as D
from graphloom.operators.skew import salted_join
from graphloom.plans.training import CURRENT_SQL, current_memories
from graphloom.sources.tables import table

PERCENTS = [50, 95, 99]
_IDENT = "key"


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "materialized").withColumns({"operation": as_key("operation"), "memory": as_key("memory_id")})


def feed_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """How far the feed is complete without a gap."""
    return D.applied_prefix(table(spark, sf, "materialized"), "sequence")


def feed_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return D.gap_starts(table(spark, sf, "materialized"), "sequence")


def feed_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """How many changes were delivered once, twice and more often."""
    counts = table(spark, sf, "materialized").groupBy("update_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return counts.groupBy("deliveries").agg(F.count(F.lit(1)).alias("n_changes"))


def feed_stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the time a change waits and takes until it can be found, by operation."""
    rows = _feed(spark, sf)
    stages = F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), c.alias("ms")) for n, c in (("queue_wait", F.col("queue_wait_ms")), ("work", F.round(F.col("update_to_searchable_ms") - F.col("queue_wait_ms"), 3)), ("total", F.col("update_to_searchable_ms")))]))
    rows = rows.select("operation", stages.alias("x")).select("operation", "x.*").where("ms is not null and not isnan(ms)")
    return V.percentile_definitions(rows, ["operation", "stage"], "ms", PERCENTS)


def _started() -> Column:
    return F.timestamp_micros(F.expr("processing_started_ns div 1000"))


def _backlog(spark: SparkSession, sf: str, width: str, span: str | None = None) -> DataFrame:
    done = F.timestamp_micros(F.expr("processing_started_ns div 1000") + F.round(F.col("update_to_searchable_ms") * 1000).cast("bigint"))
    rows = D.backlog(table(spark, sf, "materialized"), "graph_id", _started(), done, width, span)
    return rows.select("graph_id", F.unix_seconds("bucket").alias("bucket"), "produced", "applied", "backlog")


def feed_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals, completions and open changes of each graph by hour."""
    return _backlog(spark, sf, "1 hour")


def feed_backlog_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """The same by second, as an hour hides what starts and ends in it; changes never found stay open in both."""
    return _backlog(spark, sf, "1 second", "day")


def feed_searchable(spark: SparkSession, sf: str) -> DataFrame:
    """By operation and status, how many changes are found at all, first, and among the first ten."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    rank = F.col("retrieved_rank")
    return _feed(spark, sf).groupBy("operation", "status").agg(F.count(F.lit(1)).alias("n_changes"), n(rank.isNotNull()).alias("n_found"), n(rank == 1).alias("n_first"), n(rank <= 10).alias("n_top10"))


def feed_hot_memories(spark: SparkSession, sf: str) -> DataFrame:
    """Median latency of memories with many changes against the rest, and their ratio."""
    rows = _feed(spark, sf).where("memory is not null").select("memory", "update_id", F.col("update_to_searchable_ms").alias("ms"))
    counts = rows.groupBy("memory").agg((F.count(F.lit(1)) >= 8).alias("hot"))
    rows = salted_join(rows, counts, "memory", "update_id")
    p = V.percentile_definitions(rows.where("ms is not null"), ["hot"], "ms", [50], None)
    p = p.agg(F.sum(F.when(F.col("hot"), F.col("n"))).alias("n_hot"), F.max(F.when(F.col("hot"), F.col("linear"))).alias("hot_p50"), F.max(F.when(~F.col("hot"), F.col("linear"))).alias("other_p50"))
    return p.select("n_hot", F.round("hot_p50", 4).alias("hot_p50"), F.round("other_p50", 4).alias("other_p50"), F.round(F.col("hot_p50") / F.col("other_p50"), 4).alias("ratio"))


def _versions(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).where(as_key("memory_id").isNotNull()).groupBy(as_key("memory_id").alias(_IDENT)).agg(F.max("version").cast("bigint").alias("version"))


def feed_final_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The memories that must exist against the memory table and the view, version by version."""
    expected = current_memories(spark, sf).read().select("key", "version")
    return D.version_audit(expected, {"memory_version": _versions(spark, sf, "memory_by_id"), "view_version": _versions(spark, sf, "raw_erk_view")}, _IDENT)


def feed_recovery_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all changes came, all could be found, and how many memories pass the audit."""
    audit = feed_final_audit(spark, sf).agg(F.count(F.lit(1)).alias("n_memories"), F.sum(F.col("passed").cast("bigint")).alias("n_passed"))
    prefix = feed_prefix(spark, sf).select(F.col("n_waiting").alias("n_after_gap"))
    missed = table(spark, sf, "materialized").agg(F.sum((F.col("status") != "success").cast("bigint")).alias("n_missed"))
    rows = audit.join(F.broadcast(prefix)).join(F.broadcast(missed))
    return rows.withColumn("gate", (F.col("n_after_gap") == 0) & (F.col("n_missed") == 0) & (F.col("n_passed") == F.col("n_memories")))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "b2a_raw").withColumn("mode", as_key("mode")).where("error = 0 and latency_ms >= 0 and not isnan(latency_ms)")


def trial_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of latency under four definitions, by experiment, mode and hop."""
    return V.percentile_definitions(_trials(spark, sf), ["experiment", "mode", "hop"], "latency_ms", PERCENTS)


def trial_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache hit rate, mean latency and speedup against the source scan, by experiment and hop."""
    rows = _trials(spark, sf).groupBy("experiment", "hop", "mode").agg(F.count(F.lit(1)).alias("n"), F.avg("cache_hit").alias("_hit"), F.avg("latency_ms").alias("_mean"))
    base = rows.where("mode = 'src_scan'").select("experiment", "hop", F.col("_mean").alias("_base"))
    return rows.join(base, ["experiment", "hop"], "left").select("experiment", "hop", "mode", "n", F.round("_hit", 6).alias("hit_rate"), F.round("_mean", 4).alias("mean_ms"), F.round(F.col("_base") / F.col("_mean"), 4).alias("speedup"))


def trial_scan_overhead(spark: SparkSession, sf: str) -> DataFrame:
    """Edges read for each edge returned, and errors, by mode and hop."""
    rows = table(spark, sf, "b2a_raw").withColumn("mode", as_key("mode")).groupBy("mode", "hop").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("n_errors"), F.sum("raw_edges_from_db").alias("raw_edges"), F.sum("returned_edges").alias("returned_edges"))
    return rows.withColumn("read_per_returned", F.round(F.col("raw_edges") / F.nullif(F.col("returned_edges"), F.lit(0)), 4))


def trial_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Main effects on latency of the index, the cache, depth and repetition."""
    return V.main_effects(_cells(spark, sf), ["use_index", "cached", "deep", "repeated"], "latency_ms")


def trial_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Pairwise interactions of the same factors."""
    return V.interactions(_cells(spark, sf), ["use_index", "cached", "deep", "repeated"], "latency_ms")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    return _trials(spark, sf).select(flag(F.col("mode") == "src_relation_index").alias("use_index"), flag(F.col("cache_hit") == 1).alias("cached"), flag(F.col("hop") >= 3).alias("deep"), flag(F.col("experiment") != "B2a").alias("repeated"), "latency_ms")


def trial_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """How many queries returned different edge counts when run again, by mode and hop."""
    rows = _trials(spark, sf).groupBy("mode", "hop", "query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("returned_edges").alias("_low"), F.max("returned_edges").alias("_high"))
    return rows.where("_n > 1").groupBy("mode", "hop").agg(F.count(F.lit(1)).alias("n_repeated"), F.sum((F.col("_low") < F.col("_high")).cast("bigint")).alias("n_changed"))


def trial_days(spark: SparkSession, sf: str) -> DataFrame:
    """Median and interquartile range of the daily mean latency, by experiment, mode and hop."""
    daily = _trials(spark, sf).groupBy("experiment", "mode", "hop", "run_day").agg(F.avg("latency_ms").alias("_m"))
    p = lambda q: F.percentile("_m", F.lit(q))
    return daily.groupBy("experiment", "mode", "hop").agg(F.count(F.lit(1)).alias("n_days"), F.round(p(0.5), 4).alias("median_ms"), F.round(p(0.75) - p(0.25), 4).alias("iqr_ms"))


def _known_memories(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "memory_by_id").where("graph_id is not null").select("graph_id", as_key("memory_id").alias("memory_id"))
    return rows.where("memory_id is not null").distinct().select("graph_id", F.concat_ws("/", "graph_id", "memory_id").alias("memory"))


def trial_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split of the memories, a fifth of each graph for development."""
    return V.stratified_split(_known_memories(spark, sf), "memory", "graph_id")


def trial_balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    """1000 memories shared evenly among the graphs."""
    return V.balanced_sample(_known_memories(spark, sf), "memory", "graph_id", 1000)


def trial_grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split of the memories by graph: eight graphs are held out whole."""
    return V.grouped_split(_known_memories(spark, sf), "memory", "graph_id", 8)


def text_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, entity-like tokens and temporal texts of the memories of each graph."""
    rows = table(spark, sf, "memory_by_id").select("graph_id", X.tokens(F.col("raw_text")).alias("t"))
    return rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("t")).alias("n_tokens"), F.sum(F.size(F.filter("t", X.is_entity_like))).alias("n_entity_like"), F.sum(X.is_temporal(F.col("t")).cast("bigint")).alias("n_temporal"))


def text_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """How many entities, relations and keywords each view names."""
    size = lambda name: F.coalesce(F.size(F.split(X.enrichment(F.col("text"), name), r",\s*")), F.lit(0))
    parts = {c.lower(): F.when(X.enrichment(F.col("text"), c).isNull(), 0).otherwise(size(c)) for c in ("Entities", "Relations", "Keywords")}
    return table(spark, sf, "raw_erk_view").select("graph_id", as_key("memory_id").alias("memory_id"), "version", *[c.alias(f"n_{name}") for name, c in parts.items()])


def text_representations(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each of the 16 representations that put entities, relations, keywords and time after the raw text or not."""
    rows = table(spark, sf, "raw_erk_view").select("graph_id", X.raw_part(F.col("text")).alias("raw"), *[X.enrichment(F.col("text"), c).alias(c) for c in ("Entities", "Relations", "Keywords")], utc_day(F.timestamp_seconds("updated_at")).cast("string").alias("Time"))
    variants = T.variants(rows, "raw", ["Entities", "Relations", "Keywords", "Time"])
    return variants.groupBy("variant").agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def text_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Triples by verb pattern from every memory's text: how often each relation and type of object occurs."""
    rows = T.pattern_triples(table(spark, sf, "memory_by_id"), "raw_text")
    return rows.groupBy("relation", "object_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("object").alias("n_objects"))


def text_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns of every document with the speakers before and after: turns, speakers and changes of speaker."""
    turns = T.neighbour_turns(T.chat_turns(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    changed = (F.col("speaker") != F.col("next_speaker")).cast("bigint")
    return turns.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_turns"), F.countDistinct("speaker").alias("n_speakers"), F.coalesce(F.sum(changed), F.lit(0)).alias("n_changes"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_prefix,
        feed_gaps,
        feed_deliveries,
        feed_stage_latency,
        feed_backlog,
        feed_backlog_seconds,
        feed_searchable,
        feed_hot_memories,
        feed_final_audit,
        feed_recovery_gate,
        trial_latency,
        trial_cache,
        trial_scan_overhead,
        trial_effects,
        trial_interactions,
        trial_repeats,
        trial_days,
        trial_split,
        trial_balanced_sample,
        trial_grouped_split,
        text_token_stats,
        text_enrichment,
        text_representations,
        text_triples,
        text_turns,
    )
}

_KEY = "nullif(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '')"
_MEMORY = _KEY.format("memory_id")
_TRIALS = f"t AS (SELECT * REPLACE ({_KEY.format('mode')} AS mode) FROM b2a_raw WHERE error = 0 AND latency_ms >= 0 AND NOT isnan(latency_ms))"


def _percentile_sql(source: str, by: list[str], value: str) -> str:
    keys = ", ".join(by)
    at = lambda i: f"any_value(v) FILTER (WHERE r = {i})"
    spot = "(n - 1) * (pct / 100.0)::DOUBLE"
    return f"""
s AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
p AS (SELECT *, unnest({PERCENTS}) AS pct FROM s)
SELECT {keys}, CAST(pct AS INTEGER) AS pct, any_value(n) AS n,
  round({at(f"floor({spot})")} + ({at(f"ceil({spot})")} - {at(f"floor({spot})")}) * any_value({spot} - floor({spot})), 6) AS linear,
  {at(f"floor({spot})")} AS floor, {at(f"floor({spot} + 0.5)")} AS nearest, {at("least(n - 1, floor(n * (pct / 100.0)::DOUBLE))")} AS upper
FROM p GROUP BY {keys}, pct"""


_CELLS = _TRIALS + """,
c AS (SELECT CAST(mode = 'src_relation_index' AS INTEGER) AS use_index, CAST(cache_hit = 1 AS INTEGER) AS cached, CAST(hop >= 3 AS INTEGER) AS deep, CAST(experiment <> 'B2a' AS INTEGER) AS repeated, latency_ms AS v FROM t)"""
_FACTORS = ["use_index", "cached", "deep", "repeated"]
_AUDIT = CURRENT_SQL + f""",
m AS (SELECT {_MEMORY} AS k, max(version) AS v FROM memory_by_id WHERE {_MEMORY} IS NOT NULL GROUP BY 1),
w2 AS (SELECT {_MEMORY} AS k, max(version) AS v FROM raw_erk_view WHERE {_MEMORY} IS NOT NULL GROUP BY 1),
audit AS (SELECT l.memory_id AS key, CAST(l.version AS BIGINT) AS version, CAST(m.v AS BIGINT) AS memory_version, CAST(w2.v AS BIGINT) AS view_version, m.v IS NOT DISTINCT FROM l.version AND w2.v IS NOT DISTINCT FROM l.version AS passed FROM live l LEFT JOIN m ON m.k = l.memory_id LEFT JOIN w2 ON w2.k = l.memory_id)"""
_PREFIX = "SELECT max(s) FILTER (WHERE d = f) AS checkpoint, count(*) FILTER (WHERE d = f) AS n_applied, count(*) FILTER (WHERE d <> f) AS n_waiting FROM (SELECT s, d, min(d) OVER () AS f FROM (SELECT s, s - row_number() OVER (ORDER BY s) AS d FROM (SELECT DISTINCT sequence AS s FROM materialized)))"
_RAW = "regexp_replace(text, '\\n(Entities|Relations|Keywords|Triples):[\\s\\S]*$', '')"
_LINE = "nullif(regexp_extract(text, '(?m)^{0}:[ \\t]*(.*)$', 1), '')"
_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce(raw_text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 2 AND NOT list_contains(" + str(X.STOPWORDS) + ", t))"
_PATTERNS = "[" + ", ".join(f"{{'p': '{p}', 'r': '{r}'}}" for p, r in T.VERB_PATTERNS) + "]"
_TYPES = "CASE " + " ".join(f"WHEN len(list_filter({words}, lambda w: contains(object, w))) > 0 THEN '{kind}'" for kind, words in T.OBJECT_TYPES.items()) + " ELSE 'object' END"

_KNOWN = f"WITH k AS (SELECT DISTINCT graph_id, graph_id || '/' || {_MEMORY} AS memory FROM memory_by_id WHERE graph_id IS NOT NULL AND {_MEMORY} IS NOT NULL)"

SQL = {
    "feed_prefix": _PREFIX,
    "feed_gaps": "SELECT DISTINCT CAST(sequence + 1 AS BIGINT) AS missing FROM materialized WHERE sequence + 1 NOT IN (SELECT sequence FROM materialized) AND sequence < (SELECT max(sequence) FROM materialized)",
    "feed_deliveries": "SELECT deliveries, count(*) AS n_changes FROM (SELECT update_id, count(*) AS deliveries FROM materialized GROUP BY 1) GROUP BY 1",
    "feed_stage_latency": f"""WITH o AS (SELECT {_KEY.format("operation")} AS operation, queue_wait_ms AS q, update_to_searchable_ms AS u FROM materialized),
x AS (SELECT operation, 'queue_wait' AS stage, q AS ms FROM o UNION ALL SELECT operation, 'work', round(u - q, 3) FROM o UNION ALL SELECT operation, 'total', u FROM o),
y AS (SELECT * FROM x WHERE ms IS NOT NULL AND NOT isnan(ms)),{_percentile_sql("y", ["operation", "stage"], "ms")}""",
    "feed_backlog": """WITH e AS (SELECT graph_id, processing_started_ns // 1000 AS a, CAST(processing_started_ns // 1000 + round(update_to_searchable_ms * 1000) AS BIGINT) AS d FROM materialized),
x AS (SELECT graph_id, a // 3600000000 * 3600 AS bucket, 1 AS p, 0 AS f FROM e WHERE a IS NOT NULL UNION ALL SELECT graph_id, d // 3600000000 * 3600, 0, 1 FROM e WHERE d IS NOT NULL),
c AS (SELECT graph_id, bucket, sum(p) AS p, sum(f) AS f FROM x GROUP BY ALL)
SELECT graph_id, CAST(bucket AS BIGINT) AS bucket, CAST(p AS BIGINT) AS produced, CAST(f AS BIGINT) AS applied, CAST(sum(p - f) OVER (PARTITION BY graph_id ORDER BY bucket) AS BIGINT) AS backlog FROM c""",
    "feed_searchable": f"SELECT {_KEY.format('operation')} AS operation, status, count(*) AS n_changes, count(retrieved_rank) AS n_found, count(*) FILTER (WHERE retrieved_rank = 1) AS n_first, count(*) FILTER (WHERE retrieved_rank <= 10) AS n_top10 FROM materialized GROUP BY ALL",
    "feed_hot_memories": f"""WITH r AS (SELECT {_MEMORY} AS m, update_to_searchable_ms AS ms FROM materialized WHERE {_MEMORY} IS NOT NULL), h AS (SELECT m, count(*) >= 8 AS hot FROM r GROUP BY 1),
j AS (SELECT ms, hot FROM r JOIN h USING (m)), p AS (SELECT count(ms) FILTER (WHERE hot) AS n_hot, quantile_cont(ms, 0.5) FILTER (WHERE hot) AS a, quantile_cont(ms, 0.5) FILTER (WHERE NOT hot) AS b FROM j)
SELECT n_hot, round(a, 4) AS hot_p50, round(b, 4) AS other_p50, round(a / b, 4) AS ratio FROM p""",
    "feed_final_audit": _AUDIT + " SELECT * FROM audit",
    "feed_recovery_gate": _AUDIT
    + f""", g AS (SELECT count(*) AS n_memories, count(*) FILTER (WHERE passed) AS n_passed FROM audit), f AS (SELECT n_waiting AS n_after_gap FROM ({_PREFIX})), s AS (SELECT count(*) FILTER (WHERE status <> 'success') AS n_missed FROM materialized)
SELECT n_memories, n_passed, n_after_gap, n_missed, n_after_gap = 0 AND n_missed = 0 AND n_passed = n_memories AS gate FROM g, f, s""",
    "trial_latency": f"WITH {_TRIALS},{_percentile_sql('t', ['experiment', 'mode', 'hop'], 'latency_ms')}",
    "trial_cache": f"""WITH {_TRIALS}, g AS (SELECT experiment, hop, mode, count(*) AS n, avg(cache_hit) AS hit, avg(latency_ms) AS mean FROM t GROUP BY ALL)
SELECT g.experiment, g.hop, g.mode, g.n, round(g.hit, 6) AS hit_rate, round(g.mean, 4) AS mean_ms, round(b.mean / g.mean, 4) AS speedup FROM g LEFT JOIN g b ON b.mode = 'src_scan' AND b.experiment = g.experiment AND b.hop = g.hop""",
    "trial_scan_overhead": f"SELECT {_KEY.format('mode')} AS mode, hop, count(*) AS n, CAST(sum(error) AS BIGINT) AS n_errors, CAST(sum(raw_edges_from_db) AS BIGINT) AS raw_edges, CAST(sum(returned_edges) AS BIGINT) AS returned_edges, round(sum(raw_edges_from_db) / nullif(sum(returned_edges), 0), 4) AS read_per_returned FROM b2a_raw GROUP BY ALL",
    "trial_effects": f"WITH {_CELLS}\n" + " UNION ALL ".join(f"SELECT '{f}' AS factor, round(avg(v) FILTER (WHERE {f} = 1), 6) AS mean_on, round(avg(v) FILTER (WHERE {f} = 0), 6) AS mean_off, round(avg(v) FILTER (WHERE {f} = 1) - avg(v) FILTER (WHERE {f} = 0), 6) AS effect FROM c" for f in _FACTORS),
    "trial_interactions": f"WITH {_CELLS}\n"
    + " UNION ALL ".join(
        f"SELECT '{a}' AS factor_a, '{b}' AS factor_b, round((avg(v) FILTER (WHERE {a} = 1 AND {b} = 1) - avg(v) FILTER (WHERE {a} = 0 AND {b} = 1)) - (avg(v) FILTER (WHERE {a} = 1 AND {b} = 0) - avg(v) FILTER (WHERE {a} = 0 AND {b} = 0)), 6) AS interaction FROM c"
        for i, a in enumerate(_FACTORS)
        for b in _FACTORS[i + 1 :]
    ),
    "trial_repeats": f"WITH {_TRIALS} SELECT mode, hop, count(*) AS n_repeated, count(*) FILTER (WHERE lo < hi) AS n_changed FROM (SELECT mode, hop, query_id, min(returned_edges) AS lo, max(returned_edges) AS hi FROM t GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL",
    "trial_days": f"WITH {_TRIALS} SELECT experiment, mode, hop, count(*) AS n_days, round(quantile_cont(m, 0.5), 4) AS median_ms, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 4) AS iqr_ms FROM (SELECT experiment, mode, hop, run_day, avg(latency_ms) AS m FROM t GROUP BY ALL) GROUP BY ALL",
    "trial_split": f"{_KNOWN} SELECT memory, graph_id, CASE WHEN row_number() OVER (PARTITION BY graph_id ORDER BY md5('42:' || memory), memory) <= greatest(1, floor(count(*) OVER (PARTITION BY graph_id) * 0.2)) THEN 'dev' ELSE 'test' END AS part FROM k",
    "trial_balanced_sample": f"""{_KNOWN}, c AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT graph_id FROM k)),
r AS (SELECT memory, graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY md5('42:' || memory), memory) AS r FROM k)
SELECT memory, graph_id FROM r JOIN c USING (graph_id) WHERE r <= 1000 // n + CAST(i < 1000 % n AS INTEGER)""",
    "trial_grouped_split": f"{_KNOWN} SELECT memory, graph_id, CASE WHEN graph_id IN (SELECT graph_id FROM (SELECT DISTINCT graph_id FROM k) ORDER BY md5('42:k' || graph_id) LIMIT 8) THEN 'held_out' ELSE 'dev' END AS part FROM k",
    "text_token_stats": f"WITH k AS (SELECT graph_id, {_TOKENS} AS t FROM memory_by_id) SELECT graph_id, count(*) AS n_rows, CAST(sum(len(t)) AS BIGINT) AS n_tokens, CAST(sum(len(list_filter(t, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')))) AS BIGINT) AS n_entity_like, count(*) FILTER (WHERE list_has_any(t, {X.TEMPORAL_WORDS})) AS n_temporal FROM k GROUP BY 1",
    "text_enrichment": "SELECT graph_id, " + _MEMORY + " AS memory_id, version, " + ", ".join(f"CAST(coalesce(len(regexp_split_to_array({_LINE.format(c)}, ',\\s*')), 0) AS INTEGER) AS n_{c.lower()}" for c in ("Entities", "Relations", "Keywords")) + " FROM raw_erk_view",
    "text_representations": f"""WITH r AS (SELECT {_RAW} AS raw, {_LINE.format("Entities")} AS f0, {_LINE.format("Relations")} AS f1, {_LINE.format("Keywords")} AS f2, strftime(make_timestamp(CAST(floor(updated_at) AS BIGINT) * 1000000), '%Y-%m-%d') AS f3 FROM raw_erk_view),
v AS (SELECT *, unnest(range(16)) AS variant FROM r)
SELECT CAST(variant AS INTEGER) AS variant, count(*) AS n, CAST(sum(length(concat_ws(chr(10), raw, """
    + ", ".join(f"CASE WHEN variant & {1 << i} <> 0 THEN '{name}: ' || f{i} END" for i, name in enumerate(("Entities", "Relations", "Keywords", "Time")))
    + "))) AS BIGINT) AS n_chars FROM v GROUP BY 1",
    "text_triples": f"""WITH l AS (SELECT lower(raw_text) AS low FROM memory_by_id WHERE raw_text IS NOT NULL),
h AS (SELECT low, list_filter({_PATTERNS}, lambda x: contains(low, x.p))[1] AS hit FROM l),
w AS (SELECT hit, list_filter(regexp_extract_all(CASE WHEN hit IS NULL THEN low ELSE substr(low, instr(low, hit.p) + length(hit.p)) END, '[a-z]+'), lambda x: NOT list_contains({T.OBJECT_STOPWORDS}, x)) AS words FROM h),
o AS (SELECT coalesce(hit.r, 'has_memory') AS relation, CASE WHEN len(words) > 0 THEN array_to_string(words[1:CASE WHEN hit IS NULL THEN 5 ELSE 4 END], '_') WHEN hit IS NULL THEN 'memory' ELSE hit.r END AS object FROM w),
k AS (SELECT *, {_TYPES} AS object_type FROM o)
SELECT relation, object_type, count(*) AS n, count(DISTINCT object) AS n_objects FROM k GROUP BY ALL""",
    "text_turns": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS turn FROM documents),
t AS (SELECT doc_id, turn, regexp_extract(line, '^\\[\\d\\d:\\d\\d\\] ([^:]+): (.*)$', 1) AS speaker FROM l WHERE regexp_matches(line, '^\\[\\d\\d:\\d\\d\\] ([^:]+): (.*)$'))
SELECT a.doc_id, count(*) AS n_turns, count(DISTINCT a.speaker) AS n_speakers, count(*) FILTER (WHERE a.speaker <> b.speaker) AS n_changes FROM t a LEFT JOIN t b ON b.doc_id = a.doc_id AND b.turn = a.turn + 1 GROUP BY 1""",
}

SQL["feed_backlog_seconds"] = SQL["feed_backlog"].replace("// 3600000000 * 3600", "// 1000000")
