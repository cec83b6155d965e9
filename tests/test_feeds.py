from graphloom.operators.feeds import backlog
from graphloom.plans.feeds import QUERIES
from pyspark.sql import functions as F


def test_backlog_by_second_shows_open_changes(spark, sf):
    rows = QUERIES["feed_backlog_seconds"](spark, sf).collect()
    events = {}
    for r in spark.read.parquet(f"{sf}/materialized.parquet").select("graph_id", "processing_started_ns", "update_to_searchable_ms").collect():
        if r[1] is None:
            continue
        a = r[1] // 1000
        events.setdefault((r[0], a // 1_000_000), [0, 0])[0] += 1
        if r[2] is not None:
            events.setdefault((r[0], (a + round(r[2] * 1000)) // 1_000_000), [0, 0])[1] += 1
    assert {(r.graph_id, r.bucket): [r.produced, r.applied] for r in rows} == events
    open_, expected = {}, {}
    for (graph, at), (p, f) in sorted(events.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        expected[graph, at] = open_[graph] = open_.get(graph, 0) + p - f
    assert {(r.graph_id, r.bucket): r.backlog for r in rows} == expected
    assert sum(b > 0 for b in expected.values()) > sum(r.backlog > 0 for r in QUERIES["feed_backlog"](spark, sf).collect())


def test_backlog_is_carried_over_spans(spark):
    rows = [("g", 10, 11), ("g", 20, 200_000), ("g", 90_000, 300_000), ("g", 200_001, None), (None, 5, 90_000), (None, 300_000, 300_001)]
    feed = spark.createDataFrame(rows, "g string, a long, d long").select("g", F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("d").alias("d"))
    found = lambda span: {(r.g, r.bucket.timestamp(), r.produced, r.applied, r.backlog) for r in backlog(feed, "g", F.col("a"), F.col("d"), "1 second", span).collect()}
    assert found("day") == found(None)
    assert {(g, b) for g, _, _, _, b in found("day")} == {("g", 1), ("g", 0), ("g", 2), (None, 1), (None, 0)}
