from pyspark.sql import functions as F

from graphloom.operators.delete_vectors import DeleteVectorTable
from graphloom.plans.training import p2_found
from graphloom.operators.retrieval import postings
from graphloom.streaming.materializer import PAYLOAD, current, materialize, materialize_in_order, prefix_end, read_feed
from graphloom.streaming.search_index import refresh_postings

SCHEMA = "sequence long, update_id string, memory_id string, version int, operation string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_restart_repeats_and_order(spark, tmp_path):
    feed, table, checkpoint = str(tmp_path / "feed"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    add(spark, feed, [(1, "u1", "A", 1, "insert_memory"), (2, "u2", " b", 1, "insert_memory"), (3, None, None, 1, "insert_memory")])
    add(spark, feed, [(5, "u5", "a", 3, "update_relation"), (4, "u4", "a", 2, "update_relation"), (2, "u2", "b", 1, "insert_memory")])
    materialize(read_feed(spark, feed, SCHEMA), table, checkpoint)
    state = lambda: {(r.key, r.version, r.update_id) for r in current(spark, table).collect()}
    assert state() == {("a", 3, "u5"), ("b", 1, "u2")}
    # a stop, more input, among it a repeat with a higher sequence that must not outrank u7
    add(spark, feed, [(6, "u6", "b", 2, " DELETE_memory"), (7, "u7", "a", 3, "replace_relation")])
    add(spark, feed, [(9, "u5", "a", 3, "update_relation"), (8, "u8", "b", 1, "insert_memory")])
    materialize(read_feed(spark, feed, SCHEMA), table, checkpoint)
    assert state() == {("a", 3, "u7")}
    materialize(read_feed(spark, feed, SCHEMA), table, checkpoint)
    assert state() == {("a", 3, "u7")}
    assert DeleteVectorTable.open(spark, table + "/table", PAYLOAD).batches == 4


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    folder = str(tmp_path / "t")
    first = DeleteVectorTable(spark, ["update_id"], folder)
    schema = "key string, version int, sequence long, deletes boolean, update_id string"
    first.apply(spark.createDataFrame([("a", 1, 1, False, "u1")], schema))
    spark.createDataFrame([("junk",)], "key string").write.parquet(folder + "/images-2")
    again = DeleteVectorTable.open(spark, folder, ["update_id"])
    assert again.batches == 1
    again.apply(spark.createDataFrame([("b", 1, 2, False, "u2")], schema))
    assert {r.key for r in DeleteVectorTable.open(spark, folder, ["update_id"]).read().collect()} == {"a", "b"}


def test_changes_across_batches(spark, tmp_path):
    feed, table, checkpoint = str(tmp_path / "feed"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    arrive = lambda *rows: (add(spark, feed, list(rows)), materialize(read_feed(spark, feed, SCHEMA), table, checkpoint))
    state = lambda: {(r.key, r.version, r.sequence, r.update_id) for r in current(spark, table).collect()}
    # rows that are no changes come before the valid delivery of their update_id
    arrive((1, "u1", None, 1, "insert_memory"), (2, "u2", "b", None, "insert_memory"), (9, "u3", "c", 1, "insert_memory"), (5, "u4", "c", 1, "insert_memory"), (12, "u5", "d", 2, "delete_memory"))
    assert state() == {("c", 1, 9, "u3")}
    arrive((3, "u1", "a", 1, "insert_memory"), (4, "u2", "b", 1, "insert_memory"), (11, "u6", "d", 2, "insert_memory"))
    assert state() == {("a", 1, 3, "u1"), ("b", 1, 4, "u2"), ("c", 1, 9, "u3")}
    # repeats with a lower sequence: u3 and the deletion u5 fall behind their rivals, u1 moves to another memory
    arrive((3, "u3", "c", 1, "insert_memory"), (10, "u5", "d", 2, "delete_memory"), (1, "u1", "e", 1, "insert_memory"))
    assert state() == {("b", 1, 4, "u2"), ("c", 1, 5, "u4"), ("d", 2, 11, "u6"), ("e", 1, 1, "u1")}
    # a repeat that isn't lower does nothing, a rival between both places of u3 wins
    arrive((9, "u3", "c", 1, "insert_memory"), (6, "u7", "c", 1, "insert_memory"))
    assert state() == {("b", 1, 4, "u2"), ("c", 1, 6, "u7"), ("d", 2, 11, "u6"), ("e", 1, 1, "u1")}


def test_many_files_one_a_batch_give_p2_found(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/materialized.parquet")
    feed = str(tmp_path / "feed")
    # late sequences first, so that most repeats come with a lower sequence than before
    rows.repartitionByRange(6, F.col("sequence").desc()).write.parquet(feed)
    materialize(read_feed(spark, feed, rows.schema), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    assert DeleteVectorTable.open(spark, str(tmp_path / "table" / "table"), PAYLOAD).batches >= 5
    found = {(r.key, r.version, r.update_id) for r in current(spark, str(tmp_path / "table")).collect()}
    assert found == {tuple(r) for r in p2_found(spark, sf).collect()}


def test_a_late_repeat_with_a_lower_sequence_falls_behind(spark, tmp_path):
    feed, table, checkpoint = str(tmp_path / "feed"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    add(spark, feed, [(9, "u5", "a", 1, "insert_memory"), (7, "u7", "a", 1, "insert_memory")])
    add(spark, feed, [(2, "u5", "a", 1, "insert_memory")])
    materialize(read_feed(spark, feed, SCHEMA), table, checkpoint)
    assert [(r.key, r.update_id) for r in current(spark, table).collect()] == [("a", "u7")]


def test_gaps_block(spark, tmp_path):
    feed, table, checkpoint = str(tmp_path / "feed"), str(tmp_path / "table"), str(tmp_path / "checkpoint")
    arrive = lambda *rows: (add(spark, feed, list(rows)), materialize_in_order(read_feed(spark, feed, SCHEMA), table, checkpoint))
    state = lambda: {(r.key, r.update_id) for r in current(spark, table).collect()}
    arrive((2, "u2", "b", 1, "insert_memory"), (1, "u1", "a", 1, "insert_memory"), (4, "u4", "a", 2, "delete_memory"), (None, "u9", "z", 1, "insert_memory"))
    assert state() == {("a", "u1"), ("b", "u2")}
    arrive((6, "u6", "c", 1, "insert_memory"), (4, "u4", "a", 2, "delete_memory"))
    assert state() == {("a", "u1"), ("b", "u2")}
    arrive((3, "u3", "b", 2, "replace_relation"), (1, "u1", "a", 1, "insert_memory"))
    assert state() == {("b", "u3")}
    arrive((5, None, None, None, None))
    assert state() == {("b", "u3"), ("c", "u6")}
    rows = spark.createDataFrame([(3,), (5,), (6,), (6,), (None,)], "sequence long")
    assert [prefix_end(rows, n) for n in (2, 3, 4, 7)] == [3, 3, 6, 7]


def test_postings_follow_the_texts(spark):
    texts = spark.createDataFrame([("g", "1", "red apple red"), ("g", "2", "green pear"), ("g", "3", None), ("h", "1", "red plum")], "scope string, doc_id string, text string")
    changed = spark.createDataFrame([("g", "1", "blue apple", False), ("g", "2", "green pear", True), ("g", "4", "new plum", None), ("h", "9", None, False)], "scope string, doc_id string, text string, deleted boolean")
    now = {(r.scope, r.doc_id, r.term, r.tf) for r in refresh_postings(postings(texts), changed).collect()}
    assert now == {("g", "1", "blue", 1), ("g", "1", "apple", 1), ("g", "4", "new", 1), ("g", "4", "plum", 1), ("h", "1", "red", 1), ("h", "1", "plum", 1), ("h", "1", "red plum", 1)}
