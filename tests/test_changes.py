import brute
import pytest
from conftest import got

from palimpsest.functions.names import Tracked, tracked_list
from palimpsest.operators import changes

TRACKED = [Tracked("public.episodes", "id"), Tracked("messages", "id"), Tracked("agent.facts", "fact_id")]
LOG = "id long, table_name string, op string, row string, captured_at timestamp, v int, pk string, live boolean"


def log(spark, *rows):
    return spark.createDataFrame([(*r, None, 1, "x", True) for r in rows], LOG)


def live(spark, *rows):
    return got(changes.live_rows(changes.read_changes(log(spark, *rows), TRACKED)).select("table_name", "pk", "id"))


def test_order_repeats_and_revival(spark):
    assert live(
        spark, (3, "messages", "delete", '{"id":1}'), (1, "messages", "insert", '{"id":1,"a":1}'), (2, "messages", "update", '{"id":1,"a":2}'), (2, "messages", "update", '{"id":1,'),
        (4, "public.messages", "insert", '{"id":2}'), (5, "messages", "delete", '{"id":2}'), (6, "MESSAGES", " Insert\n", '{"id":2.0}'), (7, "messages", "update", '{"id":"3"}'), (7, "messages", "update", '{"id":"3"}'),
    ) == {("messages", "2", 6), ("messages", "3", 7)}


def test_void_changes(spark):
    assert live(
        spark, (1, "messages", "truncate", '{"id":1}'), (2, "messages", None, '{"id":1}'), (3, None, "insert", '{"id":1}'), (4, "other.messages", "insert", '{"id":1}'), (5, "messages", "insert", None), (6, "messages", "insert", ""),
        (7, "messages", "insert", '{"id":null}'), (8, "messages", "insert", '{"x":1}'), (9, "messages", "insert", '{"id":{"a":1}}'), (10, "messages", "insert", "[1]"), (None, "messages", "insert", '{"id":1}'), (11, "messages", "insert", '{"id":"  "}'),
    ) == set()


def test_names_keys_and_envelopes(spark):
    assert live(
        spark, (1, '"public"."episodes"', "insert", '{"op":"insert","row":{"id":"7"}}'), (2, "Episodes", "update", '{"row":{"id":7e0},"op":"update"}'), (3, "agent.facts", "insert", '{"fact_id":"f-1"}'), (4, "facts", "insert", '{"fact_id":"f-2"}'), (5, "public.facts", "insert", '{"fact_id":"f-3"}'),
    ) == {("public.episodes", "7", 2), ("agent.facts", "f-1", 3), ("agent.facts", "f-2", 4)}


def test_base_rows_are_appended_last(spark):
    read = changes.read_changes(log(spark, (5, "messages", "delete", '{"id":1}'), (6, "messages", "update", '{"id":2}')), TRACKED)
    base = spark.createDataFrame([("messages", "1", 0, True), ("messages", "2", 0, True), ("messages", "3", 0, True)], "table_name string, pk string, id long, live boolean")
    assert got(changes.live_rows(read, base).select("pk", "id")) == {("2", 6), ("3", 0)}


def test_long_rows_and_many_changes_of_one_key(spark):
    rows = [(i, "messages", "update", '{"id":1,"t":"%s"}' % ("x" * (300_000 if i == 50 else 10))) for i in range(200)]
    assert live(spark, *rows) == {("messages", "1", 199)}


def test_empty_log(spark):
    assert live(spark) == set()


def test_against_brute_force(spark, small):
    tracked = tracked_list(spark.read.parquet(f"{small}/tracked_tables.parquet"))
    found = changes.live_rows(changes.read_changes(spark.read.parquet(f"{small}/agentic_change_log.parquet"), tracked))
    assert got(found.select("table_name", "pk", "id")) == brute.p1(small)


def test_too_many_tracked_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr("palimpsest.functions.names.MAX_TRACKED", 1)
    with pytest.raises(ValueError):
        tracked_list(spark.createDataFrame([("a", "id"), ("b", "id")], "name string, pk string"))
