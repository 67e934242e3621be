import pytest
from conftest import got
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from palimpsest.functions.names import Tracked
from palimpsest.streaming import capture

TRACKED = [Tracked("messages", "id")]


def put(spark, folder, *rows):
    spark.createDataFrame([(*r, None) for r in rows], capture.FEED).coalesce(1).write.mode("append").parquet(folder)


def test_drain_twice_with_dead_letters(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, (1, "messages", "insert", '{"id":1}'), (2, "nobody", "insert", '{"id":1}'), (3, "messages", "merge", '{"id":1}'), (4, "messages", "insert", "{cut"), (5, "messages", "insert", "{}"))
    run = lambda **kw: capture.drain(capture.read_feed(spark, src), TRACKED, out, **kw).awaitTermination()
    run()
    put(spark, src, (6, "messages", "delete", '{"id":1}'))
    run()
    run()
    good, bad = capture.drained(spark, out)
    assert got(good.select("id", "pk", "op")) == {(1, "1", "insert"), (6, "1", "delete")}
    assert got(bad.select("id", "problem")) == {(2, "untracked table"), (3, "unknown op"), (4, "unreadable row"), (5, "no key")}


def test_strict_drain_writes_nothing_of_a_bad_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, src, (1, "messages", "insert", '{"id":1}'), (2, "nobody", "insert", '{"id":1}'))
    with pytest.raises(StreamingQueryException, match="untracked table"):
        capture.drain(capture.read_feed(spark, src), TRACKED, out, strict=True).awaitTermination()
    assert not (tmp_path / "out/changes").exists()


def test_heads_seal_by_size(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "table_name string, pk string, text string, id long"
    spark.createDataFrame([("messages", f"{i:02}", "x" * 64, i) for i in range(8)], schema).coalesce(1).write.parquet(src)
    feed = spark.readStream.schema(schema).parquet(src)
    q = capture.seal_heads(feed, 256, shards=1).writeStream.format("memory").queryName("sealed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("sealed").orderBy("seal_seq").collect()
    assert [(r.seal_seq, r.event_count, r.pk_lo, r.pk_hi) for r in rows] == [(0, 4, "00", "03"), (1, 4, "04", "07")]


def test_sink_lists_baseline_and_batches(spark, tmp_path):
    sink = capture.SegmentSink(str(tmp_path), [{"table_name": "a", "seal_seq": 4, "pk_lo": "0", "pk_hi": "9", "event_count": 10}])
    batch = spark.createDataFrame([("a", "5"), ("a", "3"), ("b", "1")], "table_name string, pk string")
    sink(batch, 0)
    sink(batch, 0)
    refs = sink.manifest(spark).orderBy("table_name", "seal_seq").collect()
    assert [(r["table_name"], r["seal_seq"], str(r["pk_lo"]), str(r["pk_hi"]), r["event_count"]) for r in refs] == [("a", 4, "0", "9", 10), ("a", 5, "3", "5", 2), ("b", 5, "1", "1", 1)]


def test_bounds_are_by_value_and_heads_go_on(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "table_name string, pk string, text string, id long"
    (tmp_path / "in").mkdir()
    feed = spark.readStream.schema(schema).parquet(src)
    run = lambda: capture.seal_heads(feed, 100, shards=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    for first in (0, 7):
        spark.createDataFrame([("t", k, "x" * 30, first + i) for i, k in enumerate(("9", "10", "x", "-3", "1e2", "a", "2"))], schema).coalesce(1).write.mode("append").parquet(src)
        run()
    rows = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("seal_seq", "pk_lo", "pk_hi", "event_count", "n_bytes").collect())
    assert rows == [(0, "-3", "x", 4, 120), (1, "2", "a", 4, 120), (2, "-3", "x", 4, 120)]


def test_writes_during_a_pause_are_not_captured(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, str(src), (1, "messages", "insert", '{"id":1}'))

    def start(offsets):
        """Files that are there when a new generation begins are not read by it."""
        old = {f.name for f in src.glob("*.parquet")} if not offsets.endswith("/0") else set()
        feed = capture.read_feed(spark, str(src)).where(~F.element_at(F.split("_metadata.file_path", "/"), -1).isin(list(old)) if old else F.lit(True))
        return feed.select("id").writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets).start()

    c = capture.Capture(start, str(tmp_path / "ck"))
    c.query.processAllAvailable()
    with c.paused():
        put(spark, str(src), (2, "messages", "insert", '{"id":2}'))
        assert not c.query.isActive
    put(spark, str(src), (3, "messages", "insert", '{"id":3}'))
    c.query.processAllAvailable()
    c.query.stop()
    assert {r.id for r in spark.read.parquet(out).collect()} == {1, 3}


def test_failures_escalate():
    told = []
    e = capture.Escalation(lambda level, text: told.append(level), limit=3)
    for _ in range(7):
        e.failure("x")
    assert told == ["warning", "error", "error"]
    e.onQueryProgress(None)
    e.failure("y")
    assert told[-1] == "warning" and e.failed == 1
