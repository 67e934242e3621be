import pytest
from conftest import got
from pyspark.sql import functions as F

from palimpsest.operators import folds, restoring, scanning, trees
from palimpsest.functions.names import Tracked

EVENTS = "k long, seq long, op string, a string, b string, has_a boolean, has_b boolean"


def test_last_writer_wins_by_seal_order(spark):
    df = spark.createDataFrame([(1, 0, 0, "insert", "a"), (2, 0, 1, "insert", "b"), (1, 1, 0, "update", "a2"), (2, 1, 1, "delete", None), (None, 9, 9, "insert", "z")], "k long, seal long, at long, op string, v string")
    assert got(folds.last_writer_wins(df, ["k"], ["seal", "at"], F.col("op") == "delete").select("k", "v")) == {(1, "a2")}


def test_partial_upsert_since_the_last_delete(spark):
    df = spark.createDataFrame([(1, 1, "u", "a1", "b1", True, True), (1, 2, "d", None, None, False, False), (1, 3, "u", None, "b3", False, True), (2, 1, "u", None, None, True, False), (3, 1, "d", None, None, False, False), (4, 1, "u", None, None, False, False)], EVENTS)
    out = folds.partial_upsert(df, "k", "seq", F.col("op") == "d", {"a": F.col("has_a"), "b": F.col("has_b")})
    assert got(out) == {(1, None, "b3"), (2, None, None), (4, None, None)}


def test_running_total_and_packing(spark):
    df = spark.createDataFrame([(i, (i * 7) % 13) for i in range(500)], "i int, n long")
    rows = sorted((r.i, r.t) for r in folds.running_total(df, ["i"], "n", "t", 5).collect())
    total = 0
    for i, t in rows:
        total += (i * 7) % 13
        assert t == total
    packed = folds.pack_by_bytes(df, ["i"], "n", 100).groupBy("segment_no").agg(F.sum("n").alias("s"), F.min("i").alias("lo")).collect()
    assert max(r.s for r in packed) <= 112 and sorted(r.segment_no for r in packed) == sorted(r.segment_no for r in sorted(packed, key=lambda r: r.lo))


def test_greedy_packing_as_a_writer_does_it(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        rows = [(i * 3, r.choice([0, 1, 5, 9, 30])) for i in range(r.choice([1, 2, 150]))]
        want, n, size = {}, 0, 0
        for i, s in rows:
            want[i], size = n, size + s
            if size >= 20:
                n, size = n + 1, 0
        found = folds.pack_greedily(spark.createDataFrame(rows, "i int, n long"), "i", "n", 20)
        assert {x.i: x.segment_no for x in found.collect()} == want
    assert folds.pack_greedily(spark.createDataFrame([], "i int, n long"), "i", "n", 20).count() == 0


def test_replay_batches(spark, monkeypatch):
    monkeypatch.setattr(folds, "MOST_ROWS", 4)
    monkeypatch.setattr(folds, "MOST_PARAMETERS", 9)
    rows = [("s", i, shape, key, width) for i, (shape, key, width) in enumerate([("u", "1", 1), ("u", "2", 1), ("u", "1", 1), ("d", "1", 1), ("u", "3", 4), ("u", "4", 4), ("u", "5", 4), *[("u", str(k), 1) for k in range(10, 16)]])] + [("t", 0, "u", None, 1), ("t", 1, "u", None, 99)]
    df = spark.createDataFrame(rows, "seg string, at int, shape string, k string, w int")
    out = folds.replay_batches(df, "seg", "at", F.col("shape"), F.col("k"), F.col("w"))
    assert got(out.where("seg = 's'").select("batch", "first", "n")) == {(1, 0, 2), (2, 2, 1), (3, 3, 1), (4, 4, 2), (5, 6, 4), (6, 10, 3)}
    assert got(out.where("seg = 't'").select("batch", "first", "n")) == {(1, 0, 1), (2, 1, 1)}


def test_checks_refuse_and_name(spark):
    bad = spark.createDataFrame([(1, float("nan")), (None, 1.0)], "id long, score double")
    with pytest.raises(Exception, match="non-finite value in t.score"):
        folds.finite(bad, "t").collect()
    with pytest.raises(Exception, match="null primary key in t.id"):
        folds.ordered_scan(bad, "id", "t").collect()
    good = spark.createDataFrame([(2, 0.0, None), (1, -3.14, "")], "id long, score double, note string")
    assert [r.id for r in folds.ordered_scan(folds.finite(good, "t"), "id", "t").collect()] == [1, 2]


def segments(spark, *rows):
    return restoring.envelopes(spark.createDataFrame([(s, "messages", r) for s, r in rows], "segment string, table_name string, rows array<string>"), [Tracked("messages", "id")])


def test_restore_from_segments(spark):
    e = segments(spark, ("s0", ['{"id":1,"v":"a"}', '{"id":2,"v":"b"}']), ("s1", ['{"op":"update","row":{"id":1,"v":"a2"}}', '{"op":"delete","row":{"id":2}}']))
    entries = spark.createDataFrame([("m0", 0, "s0"), ("m1", 0, "s0"), ("m1", 1, "s1")], "manifest string, pos int, segment string")
    assert got(restoring.live_rows(entries, e)) == {("m0", "messages", "1", '{"id":1,"v":"a"}'), ("m0", "messages", "2", '{"id":2,"v":"b"}'), ("m1", "messages", "1", '{"id":1,"v":"a2"}')}
    one = spark.createDataFrame([("m", 0, "s")], "manifest string, pos int, segment string")
    assert got(restoring.live_rows(one, segments(spark, ("s", ['{"op":"insert","row":{}}', "{}", '{"id":4}'])))) == {("m", "messages", "4", '{"id":4}')}
    for broken in ('{"op":"merge","row":{"id":1}}', '{"op":"delete","row":{}}', '{"id":null}'):
        one = spark.createDataFrame([("m", 0, "s")], "manifest string, pos int, segment string")
        with pytest.raises(Exception, match="in segment s"):
            restoring.live_rows(one, segments(spark, ("s", [broken]))).collect()
        assert got(restoring.live_rows(one, segments(spark, ("s", [broken])), strict=False)) == set()


def commits(spark, *rows):
    return spark.createDataFrame([(h, p, {"a.txt": t} if t else None, None, m, None, None, "1", "main", "x", "msg", None, 1, 1) for h, p, t, m in rows], "commit_hash string, parent string, prompts map<string,string>, tools map<string,string>, model string, memory_snapshot string, code_sha string, schema_version string, branch string, author string, message string, committed_at timestamp, cost_cents long, peer_uid long")


def test_commit_diffs(spark):
    c = commits(spark, ("a", None, "hi", "m1"), ("b", "a", "hello", "m1"), ("c", "b", None, "m2"), ("d", "c", "new", "m2"), ("e", "gone", "x", "m9"))
    assert {(r.commit_hash, r.dimension, r.name, r.change) for r in trees.commit_diffs(c).collect()} == {("b", "prompts", "a.txt", "modified"), ("c", "prompts", "a.txt", "removed"), ("c", "model", "", "modified"), ("d", "prompts", "a.txt", "added")}


def test_tuple_hash_ignores_metadata(spark):
    h = {r.commit_hash: r.tuple_hash for r in trees.tuple_hash(commits(spark, ("a", None, "hi", "m1"), ("b", "a", "hi", "m1"), ("c", "b", "hi", None), ("d", None, None, "m1"))).collect()}
    assert h["a"] == h["b"] and len(set(h.values())) == 3


def test_file_directory_conflicts(spark):
    df = spark.createDataFrame([("c", "A"), ("c", "a//b"), ("c", "p/q/r"), ("c", "p/q.txt"), ("d", "a"), ("d", "ab/c")], "commit_hash string, name string")
    assert got(trees.file_directory_conflicts(df, "commit_hash")) == {("c", "A", "a//b")}


def test_scan(spark):
    blob = "aB3dE5gH7jK9mN1pQ3rS5tU7vW9xY1zA+/" 
    df = spark.createDataFrame([("1", f"x {blob} y"), ("2", "AKIA" + "ABCDEFGH12345678"), ("3", "a" * 40), ("4", ""), ("5", None), ("6", "ghp_" + "a1" * 20)], "hash string, text string")
    assert got(scanning.scan(df, "hash", "text")) == {("1", "high_entropy"), ("2", "aws_access_key_id"), ("6", "github_pat")}
    assert ("1", "high_entropy") not in got(scanning.scan(df, "hash", "text", F.col("hash") == "1"))
    assert got(scanning.unlisted(scanning.scan(df, "hash", "text"), df.where("hash = '2'"), "hash").select("hash")) == {("1",), ("6",)}
