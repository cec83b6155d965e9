import random

import pytest

from graphloom.operators import delete_vectors
from graphloom.operators.delete_vectors import DeleteVectorTable, first_deliveries

SCHEMA = "key string, version int, sequence long, deletes boolean, update_id string, old string, new string"


def brute(changes):
    best = {}
    for c in changes:
        if c[0] is None or c[1] is None:
            continue
        rank = (c[1], -(2**63) if c[2] is None else c[2], c[3] is not None, bool(c[3]), c[4] or "")
        if c[0] not in best or rank > best[c[0]][0]:
            best[c[0]] = (rank, c)
    return {(k, c[1], c[4]) for k, (_, c) in best.items() if not c[3]}


def state(table):
    return {(r.key, r.version, r.update_id) for r in table.read().collect()}


def test_any_order_and_repeats(spark):
    random.seed(2)
    changes = [(random.choice(["a", "b", "c", "d", None]), random.choice([1, 2, 3, None]), i, random.random() < 0.3, f"u{i}", "x", "y") for i in range(60)]
    changes += [("hot", 1, i, False, f"h{i}", None, None) for i in range(200)]
    for order in range(2):
        random.Random(order).shuffle(changes)
        table = DeleteVectorTable(spark, ["update_id"])
        for start in range(0, len(changes), 90):
            table.apply(spark.createDataFrame(changes[start : start + 90], SCHEMA))
            assert state(table) == brute(changes[: start + 90])


def test_replay_changes_nothing_and_tombstones_hold(spark):
    first = [("a", 1, 1, False, "u1", "", ""), ("b", 1, 2, False, "u2", "", "")]
    table = DeleteVectorTable(spark, ["update_id"])
    table.apply(spark.createDataFrame(first, SCHEMA))
    table.apply(spark.createDataFrame(first, SCHEMA))
    assert state(table) == {("a", 1, "u1"), ("b", 1, "u2")}
    assert table.vectors().count() == 0
    table.apply(spark.createDataFrame([("a", 5, 9, True, "u3", "", "")], SCHEMA))
    table.apply(spark.createDataFrame([("a", 4, 10, False, "u4", "", "")], SCHEMA))
    assert state(table) == {("b", 1, "u2")}
    table.apply(spark.createDataFrame([("a", 6, 3, False, "u5", "", "")], SCHEMA))
    assert state(table) == {("a", 6, "u5"), ("b", 1, "u2")}


def test_empty_batch_and_no_batch(spark):
    table = DeleteVectorTable(spark, ["update_id"])
    with pytest.raises(ValueError):
        table.read()
    table.apply(spark.createDataFrame([], SCHEMA))
    assert state(table) == set()


def test_many_positions_across_blocks(spark):
    df = spark.range(70_000).selectExpr("cast(id as string) key", "1 version", "id sequence", "false deletes", "'old' update_id").coalesce(1)
    table = DeleteVectorTable(spark, ["update_id"])
    table.apply(df)
    table.apply(spark.range(0, 70_000, 7).selectExpr("cast(id as string) key", "2 version", "id sequence", "false deletes", "'new' update_id"))
    got = table.read()
    assert got.count() == 70_000
    assert got.where("update_id = 'new'").count() == 10_000
    assert got.select("key").distinct().count() == 70_000


def test_first_deliveries(spark):
    df = spark.createDataFrame([("u", 5, "late"), ("u", 2, "first"), ("u", None, "none"), (None, 1, "a"), (None, 1, "a")], "update_id string, sequence long, x string")
    assert sorted(tuple(map(str, r)) for r in first_deliveries(df, "update_id", "sequence").collect()) == [("None", "1", "a"), ("None", "1", "a"), ("u", "2", "first")]


def test_merges_compaction_and_reopening(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delete_vectors, "MOST_ADDITIONS", 2)
    folder = str(tmp_path / "t")
    many = [(str(k), v, v, k % 3 == 0 and v == 4, f"u{k}-{v}", "", "") for v in range(1, 7) for k in range(6)]
    table = DeleteVectorTable(spark, ["update_id"], folder, parts=2)
    for v in range(1, 7):
        table.apply(spark.createDataFrame([c for c in many if c[1] == v], SCHEMA))
    again = DeleteVectorTable.open(spark, folder, ["update_id"], parts=2)
    assert again.batches == 6 and all(len(names) <= 2 for names in again.manifest.index.values()) and len(again.manifest.vectors) <= 2
    assert state(again) == brute(many)
    again.apply(spark.createDataFrame([("2", 99, 99, True, "gone", "", "")], SCHEMA))
    again.compact()
    again = DeleteVectorTable.open(spark, folder, ["update_id"], parts=2)
    assert len(again.manifest.images) == 1 and again.vectors().isEmpty()
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("images")]) <= 8
    again.apply(spark.createDataFrame([("2", 98, 98, False, "stale", "", ""), ("1", 30, 30, False, "u1-30", "", "")], SCHEMA))
    assert state(again) == {(k, v, u) for k, v, u in brute(many) if k not in "12"} | {("1", 30, "u1-30")}
    # a key decided anew by what is known of it, and one of which nothing is left
    again.apply(spark.createDataFrame([("1", 2, 2, False, "u1-2", "", "")], SCHEMA), spark.createDataFrame([("1",), ("3",)], "key string"))
    assert {r for r in state(again) if r[0] in "13"} == {("1", 2, "u1-2")}
    again.apply(spark.createDataFrame([("3", 1, 1, False, "u3-1", "", "")], SCHEMA))
    assert ("3", 1, "u3-1") in state(again)
