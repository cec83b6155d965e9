"""Queries of evidence, representations and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.keys import as_key
from graphloom.operators import edges as E
from graphloom.operators import evidence as V
from graphloom.operators import extraction as T
from graphloom.operators import guards
from graphloom.operators import representations as R
from graphloom.operators.retrieval import bm25, top_k
from graphloom.plans import graph, retrieval
from graphloom.session import cut, new_folder
from graphloom.sources.tables import table

TURN = r"^(.+)\|(D\d+:\d+)$"


def _source(part: int) -> Column:
    return F.nullif(F.regexp_extract("source", TURN, part), F.lit(""))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """``(sample, turn, memory_id)``: the turns that sources of edges name, and the memory made from each."""
    rows = table(spark, sf, "kg_edges_by_src").select(_source(1).alias("sample"), V.with_underscore(_source(2)).alias("turn")).where("sample is not null").distinct()
    return rows.withColumn("memory_id", F.concat_ws("_", "sample", "turn"))


def evidence_memories(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that name no memory, with the memories that other edges of their graph name for the same turn."""
    rows = table(spark, sf, "kg_edges_by_src").select("graph_id", "source", "edge_id", as_key("memory_id").alias("memory_id")).where("source is not null")
    known = rows.where("memory_id is not null").select(F.col("graph_id").alias("scope"), F.col("source").alias("turn"), "memory_id")
    lost = rows.where("memory_id is null").select(F.col("graph_id").alias("scope"), F.col("source").alias("turn"), "edge_id")
    return V.by_scope_and_turn(lost, known).select(F.col("scope").alias("graph_id"), "edge_id", "memory_id")


def evidence_first_match(spark: SparkSession, sf: str) -> DataFrame:
    """The one memory of each turn that the relation table's sources name, by sample and turn or by containment."""
    asked = table(spark, sf, "kg_edges_by_relation_bucket").select(_source(1).alias("sample"), V.with_underscore(_source(2)).alias("turn"))
    # turns of every third session are kept out, so that the fallback has work
    return V.first_match(asked, _turns(spark, sf).where(F.regexp_extract("turn", r"^D(\d+)", 1).cast("int") % 3 != 0).select("sample", "turn", "memory_id"))


def evidence_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """For each sample, how many of its memories end like a turn that the relation table names for any sample."""
    asked = table(spark, sf, "kg_edges_by_relation_bucket").select(V.with_underscore(_source(2)).alias("turn")).where("turn is not null")
    return V.with_suffix(_turns(spark, sf), asked).groupBy("sample").agg(F.count(F.lit(1)).alias("n_memories"))


def evidence_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each held-out question with the turns of its conversation in the session of its category, kept where there is none."""
    turns = _turns(spark, sf)
    asked = table(spark, sf, "heldout_items").select(F.col("qa_id").alias("question_id"), V.sample_of_question(F.col("qa_id")).alias("sample"), F.concat(F.lit("D"), "category", F.lit("_"), "category").alias("turn"))
    rows = V.questions_with_turns(asked, turns)
    return rows.select("question_id", "sample", V.with_colon(F.col("turn")).alias("turn"), "memory_id", "matched")


def evidence_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the relation table, spelled with session names, resolved to memories: how many by sample are, and are not."""
    rows = table(spark, sf, "kg_edges_by_relation_bucket").select(_source(1).alias("sample"), _source(2).alias("turn")).where("sample is not null").distinct()
    names = rows.select(F.concat_ws("_", "sample", V.session_name(F.regexp_extract("turn", r"^(D\d+)", 1)), "turn").alias("reference"))
    found = V.resolve(names, _turns(spark, sf).select("memory_id"))
    sample = F.regexp_extract("reference", r"^(.+)_session_", 1)
    return found.groupBy(sample.alias("sample")).agg(F.count(F.lit(1)).alias("n_references"), F.count("memory_id").alias("n_resolved"), F.sum((V.sample_of_memory(F.col("memory_id")) == sample).cast("bigint")).alias("n_same_sample"))


def evidence_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions and turns of all ids in the sources of each graph, written without leading zeros."""
    ids = table(spark, sf, "kg_edges_by_src").select("graph_id", F.explode(X.evidence_ids(F.col("source"))).alias("turn"))
    return ids.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_ids"), F.countDistinct("turn").alias("n_turns"))


def text_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Each view's keywords as a list without repeats, the first of equals kept: their number and the list."""
    ids = X.split_ids(F.coalesce(X.enrichment(F.col("text"), "Keywords"), F.lit("")))
    return table(spark, sf, "raw_erk_view").select("graph_id", as_key("memory_id").alias("memory_id"), "version", F.size(ids).alias("n"), F.array_join(ids, ";").alias("keywords"))


def text_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The id made of each text's first eight words, and how many texts share it."""
    return table(spark, sf, "memory_by_id").where("raw_text is not null").groupBy(X.clean_id(F.col("raw_text")).alias("text_id")).agg(F.count(F.lit(1)).alias("n"))


def text_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the date or year that their text names first."""
    return table(spark, sf, "documents").groupBy(X.iso_date(F.col("text")).alias("named")).agg(F.count(F.lit(1)).alias("n"))


def text_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of at least 20 characters in the memories of each graph."""
    rows = table(spark, sf, "memory_by_id").select("graph_id", X.sentences(F.col("raw_text")).alias("s"))
    return rows.groupBy("graph_id").agg(F.sum(F.size("s")).alias("n_sentences"), F.sum(F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x))).alias("n_chars"))


def text_facts(spark: SparkSession, sf: str) -> DataFrame:
    """For each chat turn of a document the other turn of it with which it shares most words."""
    turns = T.chat_turns(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "turn", X.tokens(F.col("said")).alias("words"))
    facts = turns.where("turn % 5 = 0").select("doc_id", F.col("turn").alias("fact"), "words")
    return T.best_overlap(facts, turns.where("turn % 5 <> 0"), "doc_id", "words")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Memories with summary (the first sentence), entities, relations, keywords and triples, merged by id."""
    views = retrieval._latest(spark, sf, "raw_erk_view", "text")
    part = lambda name: views.select("doc_id", X.enrichment(F.col("text"), name).alias("text")).where("text is not null")
    base = retrieval.memories(spark, sf).select("scope", "doc_id", F.col("text").alias("raw"))
    summary = base.select("doc_id", F.element_at(F.split("raw", r"(?<=[.!?])\s+"), 1).alias("text")).where("text is not null")
    edges = retrieval._edges(spark, sf).groupBy("doc_id").agg(F.min(F.concat_ws(" ", "src_id", "relation", "dst_id")).alias("text"))
    return R.merged_features(base, {"summary": summary, "entities": part("Entities"), "relations": part("Relations"), "keywords": part("Keywords"), "triples": edges}, "doc_id")


def text_merged_features(spark: SparkSession, sf: str) -> DataFrame:
    """How many memories of each graph have which feature."""
    return _features(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in ("summary", "entities", "relations", "keywords", "triples")])


def text_seven_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Number and characters of the texts of each of the seven representations."""
    rows = R.represented(_features(spark, sf))
    return rows.groupBy("representation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def text_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Every memory's text enriched from its edges: characters, hash and number of edges."""
    rows = R.enriched(retrieval.memories(spark, sf), retrieval._edges(spark, sf))
    return rows.select("scope", "doc_id", "n_edges", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def text_rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Every memory as it stands in a prompt, its text cut to 60 characters, as length and hash."""
    text = R.rendered({"memory_id": F.col("doc_id"), "sample": F.col("scope")}, R.truncated(F.col("text"), 60))
    return retrieval.memories(spark, sf).select("doc_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("sha256"))


def text_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The facts of each document's speakers as lines, at most eight: their number and the first."""
    turns = T.chat_turns(table(spark, sf, "documents"), "doc_id", "text").where("turn < 12")
    facts = turns.groupBy("doc_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("t"))
    maps = facts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", F.transform("t", lambda x: x["said"]))))).alias("m"))
    lines = R.flattened(F.col("m"))
    return maps.select("doc_id", F.size(lines).alias("n_lines"), F.try_element_at(lines, F.lit(1)).alias("first"))


def rank_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten of the search index over the latest texts, for the first six words of each query."""
    words = F.regexp_replace(R.search_query(F.col("text")), '" OR "|"', " ")
    queries = retrieval.view_queries(spark, sf).withColumn("text", words)
    return top_k(bm25(retrieval.memories(spark, sf), queries, k1=1.2, terms=X.tokens, epsilon=0.0), 10)


def edge_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written to each access path of the edge store, and how many of the edges, tested one by one, each path finds again."""
    edges = cut(graph._canonical(spark, sf).select(*E.IDENTITY, "logical_edge_id"), "edges")
    paths = E.write_layouts(edges, new_folder(spark, "layouts"))
    return E.validate_layouts(spark, edges, paths)


def edge_layout_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The same where only two of the access paths are written."""
    edges = cut(graph._canonical(spark, sf).select(*E.IDENTITY, "logical_edge_id"), "edges")
    return E.validate_layouts(spark, edges, E.write_layouts(edges, new_folder(spark, "layouts"), only=["by_src", "by_src_relation"]))


def edge_indexed_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that bear ``likes``, read by source and relation for every source whose number is divisible by 50, in order."""
    edges = graph._canonical(spark, sf).select(*E.IDENTITY)
    path = E.write_layouts(edges, new_folder(spark, "layouts"), only=["by_src_relation"])["by_src_relation"]
    seeds = edges.where(F.regexp_extract("src_id", r"(\d+)$", 1).try_cast("bigint") % 50 == 0).select("graph_id", "src_id").distinct()
    rows = E.read_relation(spark, path, seeds, "likes")
    return V.first_of_each(rows, ["graph_id", "src_id"], ["dst_id", "source"], 20)


def edge_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first stored row of each source, in the order of the file."""
    return V.first_rows(table(spark, sf, "kg_edges_by_src").where("src_id is not null").select("graph_id", "src_id", "relation", "dst_id", "edge_id"), ["graph_id", "src_id"])


def edge_set_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Destinations that only one of the two edge tables has, beside how many both have."""
    of = lambda name: table(spark, sf, name).select(as_key("dst_id").alias("dst_id")).where("dst_id is not null")
    a, b = of("kg_edges_by_src"), of("kg_edges_by_relation_bucket")
    common = a.intersect(b).agg(F.count(F.lit(1)).alias("n_common"))
    return guards.set_difference(a, b, ["dst_id"]).join(F.broadcast(common))


def edge_skewed_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """1000 draws of seeds, four of five among the twentieth of sources with most edges; how often each is drawn."""
    degrees = E.out_degrees(graph._canonical(spark, sf)).select("graph_id", "src_id", "degree")
    return E.skewed_sequence(degrees, 1000).groupBy("graph_id", "src_id").agg(F.count(F.lit(1)).alias("n_draws"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_memories,
        evidence_first_match,
        evidence_suffixes,
        evidence_questions,
        evidence_aliases,
        evidence_ids,
        text_keywords,
        text_ids,
        text_dates,
        text_sentences,
        text_facts,
        text_merged_features,
        text_seven_forms,
        text_enriched,
        text_rendered,
        text_observations,
        rank_search,
        edge_layouts,
        edge_layout_subset,
        edge_indexed_reads,
        edge_first_rows,
        edge_set_checks,
        edge_skewed_sequence,
    )
}

_P = retrieval
_SPLIT = "nullif(regexp_extract(source, '^(.+)\\|(D\\d+:\\d+)$', {0}), '')"
_TURNS = f"turns AS (SELECT DISTINCT {_SPLIT.format(1)} AS sample, replace({_SPLIT.format(2)}, ':', '_') AS turn FROM kg_edges_by_src WHERE {_SPLIT.format(1)} IS NOT NULL), mems AS (SELECT *, sample || '_' || turn AS memory_id FROM turns)"
_ASKED = f"asked AS (SELECT DISTINCT {_SPLIT.format(1)} AS sample, replace({_SPLIT.format(2)}, ':', '_') AS turn FROM kg_edges_by_relation_bucket WHERE {_SPLIT.format(2)} IS NOT NULL)"
_LINE = "nullif(regexp_extract(text, '(?m)^{0}:[ \\t]*(.*)$', 1), '')"
_CHAT = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS turn FROM documents),
t AS (SELECT doc_id, turn, regexp_extract(line, '^\\[\\d\\d:\\d\\d\\] ([^:]+): (.*)$', 1) AS speaker, regexp_extract(line, '^\\[\\d\\d:\\d\\d\\] ([^:]+): (.*)$', 2) AS said FROM l WHERE regexp_matches(line, '^\\[\\d\\d:\\d\\d\\] ([^:]+): (.*)$'))"""
_FORMS = f"""{_P._BASE},
{_P._EDGES},
feats AS (SELECT m.scope, m.doc_id, m.text AS raw, regexp_split_to_array(m.text, '[.!?]\\s+')[1] AS s0, e.e AS entities, e.r AS relations, e.k AS keywords, t.t AS triples FROM mem m
  LEFT JOIN (SELECT doc_id, {_LINE.format("Entities")} AS e, {_LINE.format("Relations")} AS r, {_LINE.format("Keywords")} AS k FROM views) e ON e.doc_id = m.doc_id
  LEFT JOIN (SELECT doc_id, min(concat_ws(' ', src_id, relation, dst_id)) AS t FROM edges GROUP BY 1) t ON t.doc_id = m.doc_id),
feat7 AS (SELECT *, CASE WHEN s0 IS NULL THEN NULL WHEN length(s0) < length(raw) AND contains('.!?', substr(raw, length(s0) + 1, 1)) THEN substr(raw, 1, length(s0) + 1) ELSE s0 END AS summary FROM feats)"""
_ERK = "concat_ws(chr(10), CASE WHEN coalesce(entities, '') <> '' THEN 'Entities: ' || entities END, CASE WHEN coalesce(relations, '') <> '' THEN 'Relations: ' || relations END, CASE WHEN coalesce(keywords, '') <> '' THEN 'Keywords: ' || keywords END)"
_SEVEN = {
    "raw": "coalesce(raw, '')",
    "summary": "'Summary: ' || coalesce(summary, '')",
    "raw_summary": "coalesce(raw, '') || chr(10) || 'Summary: ' || coalesce(summary, '')",
    "triples": "coalesce(nullif(triples, ''), raw, '')",
    "raw_triples": "coalesce(raw, '') || coalesce(chr(10) || nullif(triples, ''), '')",
    "erk_only": _ERK,
    "raw_erk": f"coalesce(raw, '') || chr(10) || {_ERK}",
}
_LAYOUT_NAMES = ["by_src", "by_dst", "by_relation_bucket", "by_src_relation"]


def _layout_sql(names: list[str]) -> str:
    return f"WITH c AS {graph._canonical_sql()}\n" + " UNION ALL ".join(f"SELECT '{n}' AS layout, count(*) AS n_rows, count(*) FILTER (WHERE TRY_CAST(nullif(regexp_extract(src_id, '(\\d+)$', 1), '') AS BIGINT) % 50 = 0) AS n_tested, count(*) FILTER (WHERE TRY_CAST(nullif(regexp_extract(src_id, '(\\d+)$', 1), '') AS BIGINT) % 50 = 0) AS n_found, {len(names)} AS amplification FROM c" for n in names)


def _listed_sql(name: str, value: str, most: int, mark: str) -> str:
    return f"{name} AS (SELECT scope, doc_id, string_agg(v, '{mark}' ORDER BY v) AS x FROM (SELECT * FROM (SELECT DISTINCT scope, doc_id, {value} AS v FROM edges) QUALIFY dense_rank() OVER (PARTITION BY scope, doc_id ORDER BY v) <= {most}) GROUP BY ALL)"


SQL = {
    "evidence_memories": f"""WITH r AS (SELECT graph_id, source, edge_id, {_P._KEY} AS memory_id FROM kg_edges_by_src WHERE source IS NOT NULL)
SELECT a.graph_id, a.edge_id, b.memory_id FROM r a JOIN (SELECT DISTINCT graph_id, source, memory_id FROM r WHERE memory_id IS NOT NULL) b ON a.graph_id = b.graph_id AND a.source = b.source WHERE a.memory_id IS NULL""",
    "evidence_first_match": f"""WITH {_TURNS}, {_ASKED}, m AS (SELECT * FROM mems WHERE CAST(regexp_extract(turn, '^D(\\d+)', 1) AS INTEGER) % 3 <> 0),
f AS (SELECT t.turn, min(memory_id) AS within FROM (SELECT DISTINCT turn FROM asked) t JOIN m ON contains(m.memory_id, t.turn) GROUP BY 1)
SELECT a.sample, a.turn, coalesce(m.memory_id, f.within) AS memory_id, CASE WHEN m.memory_id IS NOT NULL THEN 'exact' WHEN f.within IS NOT NULL THEN 'contained' ELSE 'none' END AS how FROM asked a LEFT JOIN m ON m.sample = a.sample AND m.turn = a.turn LEFT JOIN f ON f.turn = a.turn""",
    "evidence_suffixes": f"WITH {_TURNS}, {_ASKED} SELECT sample, count(*) AS n_memories FROM mems WHERE turn IN (SELECT turn FROM asked) GROUP BY 1",
    "evidence_questions": f"""WITH {_TURNS}, q AS (SELECT qa_id, nullif(regexp_extract(qa_id, '^(.+)_qa_\\d+$', 1), '') AS sample, 'D' || category || '_' || category AS turn FROM heldout_items)
SELECT q.qa_id AS question_id, q.sample, replace(q.turn, '_', ':') AS turn, m.memory_id, m.memory_id IS NOT NULL AS matched FROM q LEFT JOIN mems m ON m.sample = q.sample AND m.turn = q.turn""",
    "evidence_aliases": f"WITH {_TURNS}, {_ASKED} SELECT a.sample, count(*) AS n_references, count(m.memory_id) AS n_resolved, CAST(nullif(count(m.memory_id), 0) AS BIGINT) AS n_same_sample FROM asked a LEFT JOIN mems m ON m.sample = a.sample AND m.turn = a.turn GROUP BY 1",
    "evidence_ids": "WITH i AS (SELECT graph_id, unnest(regexp_extract_all(source, 'D\\s*:?\\s*\\d+\\s*:\\s*\\d+')) AS x FROM kg_edges_by_src), t AS (SELECT graph_id, CAST(regexp_extract(x, '(\\d+)\\s*:\\s*(\\d+)', 1) AS INTEGER) || ':' || CAST(regexp_extract(x, '(\\d+)\\s*:\\s*(\\d+)', 2) AS INTEGER) AS turn FROM i) SELECT graph_id, count(*) AS n_ids, count(DISTINCT turn) AS n_turns FROM t GROUP BY 1",
    "text_keywords": f"""WITH r AS (SELECT graph_id, {_P._KEY} AS memory_id, version, list_filter(list_transform(regexp_split_to_array(coalesce({_LINE.format("Keywords")}, ''), '[;,|]'), lambda x: trim(x)), lambda x: x <> '') AS k FROM raw_erk_view),
u AS (SELECT *, list_filter(k, lambda x, i: list_position(k, x) = i) AS d FROM r) SELECT graph_id, memory_id, version, CAST(len(d) AS INTEGER) AS n, array_to_string(d, ';') AS keywords FROM u""",
    "text_ids": "SELECT array_to_string(list_filter(regexp_split_to_array(lower(trim(raw_text)), '\\s+'), lambda w: w <> '')[1:8], '_') AS text_id, count(*) AS n FROM memory_by_id WHERE raw_text IS NOT NULL GROUP BY 1",
    "text_dates": """WITH m AS (SELECT text, regexp_extract(text, '(\\d{1,2})\\s+([A-Za-z]+),?\\s+(\\d{4})', ['d', 'm', 'y']) AS x, regexp_extract(text, '\\b((?:19|20)\\d{2})\\b', 1) AS y FROM documents),
n AS (SELECT x, y, list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(x.m)) AS i FROM m)
SELECT CASE WHEN i > 0 THEN x.y || '-' || lpad(CAST(i AS VARCHAR), 2, '0') || '-' || lpad(x.d, 2, '0') WHEN y <> '' THEN y END AS named, count(*) AS n FROM n GROUP BY 1""",
    "text_facts": f"""WITH {_CHAT},
w AS (SELECT doc_id, turn, unnest(list_distinct({_P._tokens_sql("said")})) AS w FROM t),
s AS (SELECT a.doc_id, a.turn AS fact, b.turn, count(*) AS shared FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.w = b.w AND a.turn % 5 = 0 AND b.turn % 5 <> 0 GROUP BY ALL)
SELECT doc_id, CAST(fact AS INTEGER) AS fact, CAST(turn AS INTEGER) AS turn, shared FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, fact ORDER BY shared DESC, turn) = 1""",
    "text_merged_features": f"{_FORMS} SELECT scope, count(*) AS n, count(summary) AS n_summary, count(entities) AS n_entities, count(relations) AS n_relations, count(keywords) AS n_keywords, count(triples) AS n_triples FROM feat7 GROUP BY scope",
    "text_seven_forms": f"{_FORMS} " + " UNION ALL ".join(f"SELECT '{name}' AS representation, count(*) AS n, CAST(sum(length({text})) AS BIGINT) AS n_chars FROM feat7" for name, text in _SEVEN.items()),
    "text_enriched": f"""{_P._BASE},
{_P._EDGES},
{_listed_sql("ents", f"unnest(list_concat({_P._tokens_sql('src_id')}, {_P._tokens_sql('dst_id')}))", 15, ", ")},
{_listed_sql("rels", f"unnest({_P._tokens_sql('relation')})", 10, ", ")},
{_listed_sql("trips", "'(' || coalesce(src_id, '') || ', ' || coalesce(relation, '') || ', ' || coalesce(dst_id, '') || ')'", 10, "; ")},
g AS (SELECT scope, doc_id, count(*) AS n, bool_or(list_has_any(list_concat({_P._tokens_sql("src_id")}, list_concat({_P._tokens_sql("relation")}, {_P._tokens_sql("dst_id")})), {_P._TIMES})) AS timed FROM edges GROUP BY ALL),
x AS (SELECT m.scope, m.doc_id, coalesce(g.n, 0) AS n_edges, CASE WHEN g.n IS NULL THEN coalesce(m.text, '') ELSE concat_ws(chr(10), coalesce(m.text, ''), 'Entities: ' || coalesce(e.x, ''), 'Relations: ' || coalesce(r.x, ''), 'Triples: ' || coalesce(t.x, ''), CASE WHEN g.timed THEN 'Temporal: true' END,
  'Keywords: ' || array_to_string(list_sort(list_distinct(list_concat({_P._tokens_sql("m.text")}, {_P._tokens_sql("e.x")})))[1:20], ', ')) END AS text
  FROM mem m LEFT JOIN g ON g.scope = m.scope AND g.doc_id = m.doc_id LEFT JOIN ents e ON e.scope = m.scope AND e.doc_id = m.doc_id LEFT JOIN rels r ON r.scope = m.scope AND r.doc_id = m.doc_id LEFT JOIN trips t ON t.scope = m.scope AND t.doc_id = m.doc_id)
SELECT scope, doc_id, n_edges, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS sha256 FROM x""",
    "text_rendered": f"{_P._BASE}, x AS (SELECT doc_id, 'memory_id=' || doc_id || ' | sample=' || scope || chr(10) || 'Text: ' || CASE WHEN length(trim(coalesce(text, ''))) <= 60 THEN trim(coalesce(text, '')) ELSE rtrim(substr(trim(text), 1, 60)) || '...' END AS t FROM mem) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha256 FROM x",
    "text_observations": f"""WITH {_CHAT},
f AS (SELECT doc_id, '- ' || speaker || ': ' || trim(said) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY speaker, turn) AS r FROM t WHERE turn < 12 AND trim(said) <> '')
SELECT d.doc_id, CAST(least(8, count(f.line)) AS INTEGER) AS n_lines, any_value(f.line) FILTER (WHERE f.r = 1) AS first FROM (SELECT DISTINCT doc_id FROM t WHERE turn < 12) d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1""",
    "rank_search": f"""{_P._BASE},
qs AS (SELECT scope, query_id, array_to_string(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[一-鿿]+'), lambda w: length(w) > 1)[1:6], ' ') AS text FROM q),
{_P._bm25_sql("s", "mem", "qs", "tokens", k1=1.2, epsilon=0.0)}
SELECT * FROM {_P._top("sscore", 10)}""",
    "edge_layouts": _layout_sql(_LAYOUT_NAMES),
    "edge_layout_subset": _layout_sql(["by_src", "by_src_relation"]),
    "edge_indexed_reads": f"WITH c AS {graph._canonical_sql()} SELECT graph_id, src_id, relation, dst_id, source FROM c WHERE relation = 'likes' AND TRY_CAST(nullif(regexp_extract(src_id, '(\\d+)$', 1), '') AS BIGINT) % 50 = 0 QUALIFY row_number() OVER (PARTITION BY graph_id, src_id ORDER BY dst_id, source) <= 20",
    "edge_first_rows": "WITH r AS (SELECT graph_id, src_id, relation, dst_id, edge_id, row_number() OVER () AS nr FROM kg_edges_by_src) SELECT graph_id, src_id, relation, dst_id, edge_id FROM r WHERE src_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY graph_id, src_id ORDER BY nr) = 1",
    "edge_set_checks": f"""WITH a AS (SELECT DISTINCT {_P._KEY.replace("memory_id", "dst_id")} AS dst_id FROM kg_edges_by_src), b AS (SELECT DISTINCT {_P._KEY.replace("memory_id", "dst_id")} AS dst_id FROM kg_edges_by_relation_bucket), n AS (SELECT count(*) AS n FROM a JOIN b USING (dst_id))
SELECT dst_id, 'missing' AS side, n AS n_common FROM a, n WHERE dst_id NOT IN (SELECT dst_id FROM b WHERE dst_id IS NOT NULL) UNION ALL SELECT dst_id, 'unexpected', n FROM b, n WHERE dst_id NOT IN (SELECT dst_id FROM a WHERE dst_id IS NOT NULL)""",
    "edge_skewed_sequence": f"""WITH c AS {graph._canonical_sql()}, d AS (SELECT graph_id, src_id, row_number() OVER (ORDER BY count(*) DESC, graph_id, src_id) - 1 AS place, count(*) OVER () AS n FROM c GROUP BY graph_id, src_id),
k AS (SELECT any_value(n) AS n, greatest(1, any_value(n) // 20) AS hot FROM d),
s AS (SELECT CAST('0x' || substr(md5('42:' || i), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5('42:' || i), 9, 8) AS BIGINT) AS b FROM (SELECT unnest(range(1000)) AS i))
SELECT graph_id, src_id, count(*) AS n_draws FROM s, k JOIN d ON d.place = CASE WHEN a % 5 < 4 THEN b % hot ELSE b % k.n END GROUP BY ALL""",
}
SQL["text_sentences"] = "WITH s AS (SELECT graph_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(raw_text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM memory_by_id) SELECT graph_id, CAST(sum(len(s)) AS BIGINT) AS n_sentences, CAST(sum(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)) AS BIGINT) AS n_chars FROM s GROUP BY 1"
