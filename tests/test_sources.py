import json

import pytest

from graphloom.operators.edges import canonical_edges, write_layouts
from graphloom.operators.guards import equivalent, file_hashes, hash_gate, set_difference
from graphloom.sources import files


def test_edges_under_other_names(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("﻿graph,source_id,predicate,target_id,confidence\ng, a ,likes,b,0.5\ng,a,likes,c,odd\ng,,likes,c,1\n", encoding="utf-8")
    rows = files.read_edges(spark, str(path))
    assert [tuple(r) for r in rows.orderBy("dst_id", "src_id").collect()][0] == ("g", "a", "likes", "b", "synthetic", "ENTITY", "ENTITY", 0.5)
    assert {r.confidence for r in rows.collect()} == {0.5, 1.0}
    assert files.invalid_edges(rows).count() == 1
    (tmp_path / "bad.csv").write_text("graph_id,src_id\ng,a\n")
    with pytest.raises(ValueError, match="relation"):
        files.read_edges(spark, str(tmp_path / "bad.csv"))


def test_manifest(spark, tmp_path):
    rows = [{"query_id": "q1", "graph_id": "g", "seed_id": "a", "relation_path": ["likes"], "hop": 1, "fanout": 2}, {"query_id": "q2", "graph_id": "g", "seed_id": "a", "relation_path": [], "hop": 2, "fanout": 2}, {"query_id": "q2", "graph_id": "g", "seed_id": "a", "relation_path": ["x"], "hop": 2, "fanout": 0}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    df = files.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r.relation_path for r in df.orderBy("query_id", "fanout").collect()] == [["likes"], ["x"], ["*", "*"]]
    assert {tuple(r) for r in files.invalid_queries(df).collect()} == {("q2", "repeated id"), ("q2", "fanout below 1")}


def test_conversations(spark, tmp_path):
    sample = {"sample_id": "conv-1", "conversation": {"session_1": [{"speaker": "Ann", "dia_id": "D1:1", "text": "Hi"}, {"speaker": "Bo", "dia_id": "D1:2", "text": "Yo"}], "session_1_date_time": "1:56 pm on 8 May, 2023", "session_2": []}}
    (tmp_path / "c.json").write_text(json.dumps([sample]))
    assert [tuple(r) for r in files.read_conversations(spark, str(tmp_path / "c.json")).orderBy("turn").collect()] == [("conv-1", 1, 1, "D1:1", "Ann", "Hi", "1:56 pm on 8 May, 2023"), ("conv-1", 1, 2, "D1:2", "Bo", "Yo", "1:56 pm on 8 May, 2023")]


def test_vectors_and_sinks(spark, tmp_path):
    df = files.unit_vectors(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>"), "v")
    assert [r.v for r in df.collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], None]
    rows = spark.createDataFrame([(1, "a,b\"c", 2)], "z int, t string, extra int")
    files.write_csv(rows, str(tmp_path / "out"), ["z", "t"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "out")).collect()] == [("1", 'a,b"c')]
    files.write_csv(rows, str(tmp_path / "out"), ["z", "t"], mode="append")
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 2
    files.write_json_lines(rows, str(tmp_path / "j"))
    # some partitions have no row and write an empty file
    text = "".join(file.read_text() for file in (tmp_path / "j").glob("*.json"))
    assert list(json.loads(text)) == ["extra", "t", "z"]


def test_layouts_and_guards(spark, tmp_path):
    edges = canonical_edges(spark.createDataFrame([("g", "a", "likes", f"d{i}", None) for i in range(20)] + [("g", "a", "likes", "d1", " ")], "graph_id string, src_id string, relation string, dst_id string, source string"))
    assert edges.count() == 20 and edges.where("copies = 2").count() == 1
    paths = write_layouts(edges, str(tmp_path))
    assert len(paths) == 4
    for path in paths.values():
        assert equivalent(edges, spark.read.parquet(path), ["logical_edge_id"])
    other = edges.where("dst_id <> 'd3'").selectExpr("logical_edge_id").union(spark.createDataFrame([("Lx",)], "logical_edge_id string"))
    assert sorted(r.side for r in set_difference(edges, other, ["logical_edge_id"]).collect()) == ["missing", "unexpected"]
    a, b = (spark.createDataFrame(rows, "k string, h string") for rows in ([("1", "x"), ("2", "y")], [("1", "x"), ("2", "z"), ("3", "w")]))
    assert {tuple(r) for r in hash_gate(a, b, "k", "h").collect()} == {("1", True), ("2", False), ("3", False)}
    assert all(len(r.sha256) == 64 for r in file_hashes(spark, str(tmp_path / "by_src")).collect())


def test_logical_id_is_that_of_the_json_array(spark):
    import hashlib

    values = ("g", 'a"\\b', "né 中", "d/x\t", "")
    df = spark.createDataFrame([values], "graph_id string, src_id string, relation string, dst_id string, source string")
    expected = "L" + hashlib.sha1(json.dumps(["g", 'a"\\b', "né 中", "d/x", ""], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:24]
    assert canonical_edges(df).collect()[0].logical_edge_id == expected


def test_vectors_with_ids_and_json(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b\na\n")
    spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "position int, embedding array<double>").write.parquet(str(tmp_path / "v"))
    got = {r.id: r.embedding for r in files.read_vectors(spark, str(tmp_path / "v"), str(tmp_path / "ids.txt")).collect()}
    assert got == {"b": [0.6, 0.8], "a": [0.0, 0.0]}
    (tmp_path / "more.txt").write_text("b\na\nc\n")
    with pytest.raises(ValueError):
        files.read_vectors(spark, str(tmp_path / "v"), str(tmp_path / "more.txt"))
    digest = files.write_json(spark, str(tmp_path / "x.json"), {"b": 1, "a": "é"})
    assert (tmp_path / "x.json").read_text() == '{"a": "é", "b": 1}' and len(digest) == 64 and not (tmp_path / "x.json.draft").exists()
