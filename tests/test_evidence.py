import pytest
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import evidence as V
from graphloom.operators import readers as A
from graphloom.operators import representations as R


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def test_ids(spark):
    lit = F.lit
    assert one(spark, V.with_underscore(lit(" D1:3"))) == "D1_3" and one(spark, V.with_colon(lit("D1_3"))) == "D1:3" and one(spark, V.with_colon(lit("x_3"))) == "x_3"
    assert [one(spark, V.session_name(lit(x))) for x in ("3", "S03", "session_9", "", None, "none")] == ["session_3", "session_3", "session_9", "", "", "none"]
    assert one(spark, V.sample_of_question(lit("conv-26_qa_0001"))) == "conv-26" and one(spark, V.sample_of_question(lit("x"))) is None
    assert one(spark, V.sample_of_memory(lit("conv-26_D3:12"))) == "conv-26" and one(spark, V.sample_of_memory(lit(None).cast("string"))) is None


def test_evidence_meets_memories(spark):
    memories = spark.createDataFrame([("a", "D1_1", "a_D1_1"), ("a", "D1_12", "a_D1_12"), ("b", "D1_12", "b_D1_12"), ("b", "D2_3", "b_D2_3"), ("b", "D2_3", "b_D2_3"), (None, "D9_9", None)], "sample string, turn string, memory_id string")
    edges = spark.createDataFrame([("a", "D1_1", 1), ("b", "D2_3", 2), ("b", "D2_3", 2), ("c", "D1_1", 3), (None, "D1_1", 4), ("a", None, 5)], "scope string, turn string, n int")
    met = V.by_scope_and_turn(edges, memories.withColumnRenamed("sample", "scope"))
    assert rows(met, "n", "memory_id") == [(1, "a_D1_1"), (2, "b_D2_3"), (2, "b_D2_3")]
    asked = [("a", "D1_1"), ("c", "D1_1"), ("c", "D1_12"), ("c", "D2_1"), ("b", "D2"), (None, "D2_3"), ("a", None)]
    found = V.first_match(spark.createDataFrame(asked, "sample string, turn string"), memories)
    known = sorted(r.memory_id for r in memories.collect() if r.memory_id)
    for sample, turn, memory, how in rows(found):
        exact = [m for m in known if m == f"{sample}_{turn}"]
        within = [m for m in known if turn in m] if turn != "D2" else []
        assert (memory, how) == (exact[0], "exact") if exact else (within[0], "contained") if within else (None, "none")
    assert found.count() == 6
    ends = V.with_suffix(memories.where("memory_id is not null"), spark.createDataFrame([("D1_12",), ("D1_12",), (None,)], "turn string"))
    assert sorted({r.memory_id for r in ends.collect()}) == ["a_D1_12", "b_D1_12"]
    questions = spark.createDataFrame([("q1", "b", "D2_3"), ("q2", "b", "D7_7"), ("q3", None, None)], "question_id string, sample string, turn string")
    assert rows(V.questions_with_turns(questions, memories), "question_id", "memory_id", "matched") == [("q1", "b_D2_3", True), ("q2", None, False), ("q3", None, False)]
    assert V.first_match(found.limit(0), memories).collect() == []


def test_aliases_and_first_rows(spark):
    memories = spark.createDataFrame([("conv_D3_12",), ("other",), ("x:1",), ("",), (None,)], "memory_id string")
    names = ["conv_D3_12", "conv_D3:12", "conv_session_3_D3:12", "conv_session_3_D3_12", "x_1", "x:1", "nobody", " other "]
    got = dict(rows(V.resolve(spark.createDataFrame([(n,) for n in names], "reference string"), memories)))
    assert got == {**{n: "conv_D3_12" for n in names[:4]}, "x_1": "x:1", "x:1": "x:1", "nobody": None, "other": "other"}
    df = spark.createDataFrame([("a", 3), ("b", None), ("a", 1), (None, 7), ("b", 2)], "k string, v int").coalesce(1)
    assert rows(V.first_rows(df, ["k"])) == [("a", 3), ("b", None), (None, 7)]


def test_texts(spark):
    df = spark.createDataFrame([("m", "Raw text.", None, "A, B", None, "k", ""), ("n", None, "Sum", None, None, None, "t")], "id string, raw string, summary string, entities string, relations string, keywords string, triples string")
    got = {(r.id, r.representation): r.text for r in R.represented(df).collect()}
    assert got["m", "summary"] == "Summary: " and got["m", "triples"] == "Raw text." and got["m", "raw_erk"] == "Raw text.\nEntities: A, B\nKeywords: k"
    assert got["n", "raw_triples"] == "\nt" and got["n", "erk_only"] == "" and len(got) == 14
    merged = R.merged_features(spark.createDataFrame([("m", 1), ("n", 2)], "memory_id string, x int"), {"summary": spark.createDataFrame([("m", "b"), ("m", "a"), ("z", "c")], "memory_id string, text string")})
    assert rows(merged, "memory_id", "x", "summary") == [("m", 1, "b"), ("n", 2, None)]
    lit = F.lit
    assert one(spark, R.truncated(lit(" abcd efgh "), 5)) == "abcd..." and one(spark, R.truncated(lit(None).cast("string"), 5)) == ""
    assert one(spark, R.rendered({"a": lit("x"), "b": lit(" "), "c": lit(3)}, lit("t"))) == "a=x | c=3\nText: t" and one(spark, R.rendered({"a": lit(None)}, lit(" t"))) == "t"
    facts = F.create_map(lit("Ann"), F.array(lit("one"), lit(" "), lit("two")), lit("Bo"), F.array(lit("three")))
    assert one(spark, R.flattened(facts, 2)) == ["- Ann: one", "- Ann: two"] and one(spark, R.flattened(lit(None).cast("map<string, array<string>>"))) == []
    assert one(spark, R.search_query(lit("a big_dog, 会议 x 12!"))) == '"big_dog" OR "会议" OR "12"' and one(spark, R.search_query(lit(None).cast("string"))) == '""'


def test_enriched(spark):
    memories = spark.createDataFrame([("s", "m1", "We met."), ("s", "m2", None)], "scope string, doc_id string, text string")
    edges = [("s", "m1", f"person:p{i:02d}", "knows", "yesterday") for i in range(30)] + [("s", "m1", "person:p00", "knows", "yesterday"), ("s", "m9", None, None, None)]
    got = {r.doc_id: r for r in R.enriched(memories, spark.createDataFrame(edges, "scope string, doc_id string, src_id string, relation string, dst_id string")).collect()}
    lines = got["m1"].text.split("\n")
    assert got["m1"].n_edges == 31 and lines[0] == "We met." and lines[1] == "Entities: " + ", ".join([f"p{i:02d}" for i in range(15)])
    assert lines[2] == "Relations: knows" and lines[3].count("; ") == 9 and lines[4] == "Temporal: true" and lines[5].startswith("Keywords: met, p00")
    assert (got["m2"].text, got["m2"].n_edges) == ("", 0)


def test_readers(spark):
    lit = F.lit
    outcome = lambda p, a: one(spark, A.adversarial_outcome(lit(p), lit(a)))
    assert [outcome(*x) for x in (("Cannot answer", "x"), ("It is the blue boat", "Blue Boat"), ("a boat", "blue boat"), ("nothing like it", "zebra"), ("boat", ""))] == ["abstained", "leaked", "partial", "new_fact", "unknown"]
    assert one(spark, A.answer_in_evidence(lit("There were three."), lit("3"))) is True and one(spark, A.answer_in_evidence(lit("x"), lit(None).cast("string"))) is None
    assert [one(spark, A.rank_label(lit(r).cast("int"))) for r in (3, 11, None)] == ["3", ">10", "none"]
    wrong = lambda f1: one(spark, A.wrong_abstentions(lit(True), lit(f1), lit("x"))["wrong_abstention_f1"])
    assert (wrong(0.0), wrong(0.5)) == (1, 0)
    a = spark.createDataFrame([("1", "g", 1.0), ("2", "g", 0.0), ("3", "g", 0.5)], "id string, c string, v double")
    b = spark.createDataFrame([("1", 1.0), ("2", 1.0), ("3", 0.0), ("4", 1.0)], "id string, v double")
    assert rows(A.win_tie_loss(a, b, "id", "v", "c")) == [("g", 3, 1, 1, 1)]
    assert rows(A.changed_share(a, b, "id", "v")) == [(3, 2, 0.666667)]
    old, new = (spark.createDataFrame([("m", None, x), ("n", "c", 0.0)], "k string, c string, r double") for x in (0.5, 0.4))
    assert rows(A.metric_differences(old, new, ["k", "c"], ["r"])) == [("m", None, "r", 0.5, 0.4, -0.1, -20.0), ("n", "c", "r", 0.0, 0.0, 0.0, 0.0)]
    lists = spark.createDataFrame([("q", "d1"), ("q", "d2"), ("p", "d3")], "query_id string, doc_id string")
    assert rows(A.covered_lists(lists, lists.where("doc_id = 'd1'"))) == [("p", 1, 0, 0.0), ("q", 2, 1, 0.5)]
    cases = spark.createDataFrame([(f"q{i:02d}", 9 + i % 2, i % 5, 0.0, i % 2) for i in range(60)], "query_id string, n_covered int, overlap int, f1 double, hit int")
    picked = A.hard_cases(cases, first=4, whole=6).orderBy("query_id").collect()
    assert [r.reason for r in picked].count("hard") == 4 and [r.reason for r in picked].count("hit") == 2 and len({r.query_id for r in picked}) == 6
    spread = spark.createDataFrame([("g", float(v)) for v in (5, 1, 9, 3, 7)] + [("h", 2.0), ("h", 4.0), ("e", None)], "g string, v double")
    assert rows(A.upper_median(spread, ["g"], "v")) == [("g", 5, 5.0, 4.0), ("h", 2, 4.0, 2.0)]


def test_layouts_and_sequences(spark, tmp_path):
    edges = spark.createDataFrame([("g", f"p_{i}", "r" if i % 2 else "q", f"d{i % 3}", "") for i in range(200)], "graph_id string, src_id string, relation string, dst_id string, source string")
    paths = E.write_layouts(edges, str(tmp_path / "l"))
    assert rows(E.validate_layouts(spark, edges, paths)) == sorted((n, 200, 4, 4, 4) for n in E.LAYOUTS)
    lossy = str(tmp_path / "lossy")
    edges.where("src_id <> 'p_50'").write.parquet(lossy)
    assert rows(E.validate_layouts(spark, edges, {"by_src": lossy}), "n_found", "n_tested") == [(3, 4)]
    assert set(E.write_layouts(edges, str(tmp_path / "s"), only=["by_dst"])) == {"by_dst"}
    read = E.read_relation(spark, paths["by_src_relation"], spark.createDataFrame([("g", "p_1"), ("g", "p_2")], "graph_id string, src_id string"), "r")
    assert rows(read, "src_id") == [("p_1",)]
    degrees = spark.createDataFrame([("g", f"s{i:03d}", 100 - i) for i in range(100)], "graph_id string, src_id string, degree int")
    draws = E.skewed_sequence(degrees, 500).collect()
    assert len(draws) == 500 and 350 < sum(r.src_id < "s005" for r in draws) < 450
    assert E.skewed_sequence(degrees.limit(0), 5).collect() == []


def test_names_are_checked(spark):
    from graphloom.sources.tables import identifier

    assert identifier("kg_edges_by_src") == "kg_edges_by_src"
    for name in ("a b", "x;drop", "../x", "", "1a"):
        with pytest.raises(ValueError):
            identifier(name)
