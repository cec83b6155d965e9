from graphloom.__main__ import main


def test_edges_to_manifest_and_back(spark, tmp_path, capsys):
    edges = tmp_path / "edges.csv"
    edges.write_text("graph_id,src_id,relation,dst_id,source\ng,quay,road,bridge,a\ng,quay,road,bridge,a\ng,bridge,lane,mill,\ng,bridge,lane,inn,\ng,mill,lane,quay,\n")
    assert main(["canonicalize", str(edges), str(tmp_path / "c")], spark) == 0
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    assert main(["generate-manifest", str(edges), str(tmp_path / "m"), "5", "road", "lane"], spark) == 0
    (row,) = spark.read.json(str(tmp_path / "m")).collect()
    assert (row.query_id, row.expected_path_count, row.hop) == ("quay", 2, 2)
    assert main(["manifest", str(tmp_path / "m")], spark) == 0
    assert main(["validate", str(tmp_path / "m"), str(edges)], spark) == 0
    edges.write_text("graph_id,src_id,relation,dst_id,source\ng,quay,road,bridge,a\ng,bridge,lane,mill,\n,x,y,z,\n")
    assert main(["validate", str(tmp_path / "m"), str(edges)], spark) == 2
    assert main(["canonicalize", str(edges), str(tmp_path / "d")], spark) == 2
    assert main(["profile", str(edges)], spark) == 0
    assert "n_sources" in capsys.readouterr().out


def test_usage(capsys):
    assert main([]) == 1 and main(["run", "no such query", "a", "b"]) == 1 and main(["list"]) == 0
    assert "p2_found" in capsys.readouterr().out
