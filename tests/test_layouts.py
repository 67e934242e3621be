import json
from datetime import datetime as D

from conftest import got

from palimpsest.functions.names import Tracked
from palimpsest.operators import layouts

TRACKED = [Tracked("messages", "id"), Tracked("public.episodes", "id")]
EV = "event_no long, table_name string, op string, row string, schema_version string, field string, version int"
SEG = "segment string, table_name string, schema_version string, rows array<string>, sealed_at timestamp"
MIG = "id int, name string, applied_at timestamp"


def rows_of(spark, events, segments=()):
    e = spark.createDataFrame([(i, "messages", "update", json.dumps(r) if isinstance(r, dict) else r, v, "f", 1) for i, (v, r) in enumerate(events)], EV)
    return layouts.versioned_rows(e, spark.createDataFrame([(f"s{i}", "messages", v, r, D(2026, 1, 1)) for i, (v, r) in enumerate(segments)], SEG), TRACKED)


def migrations(spark):
    return spark.createDataFrame([(2, "0.1.0", None), (3, "0.10.0", None), (1, "0.0.5", None)], MIG)


def test_all_changes(spark):
    before = [("0.0.5", {"id": i, "text": f"t{i}", "n": i, "flag": True, "old": f"o{i}"}) for i in range(40)]
    after = [("v0.1.0 ", {"id": i, "body": f"t{i}", "n": str(i), "flag": True, "new": f"z{i}", "tags": []}) for i in range(40)]
    found = got(layouts.layout_changes(rows_of(spark, before + after), migrations(spark), TRACKED).select("schema_version", "change", "field", "new_field"))
    assert found == {("0.1.0", "renamed", "text", "body"), ("0.1.0", "retyped", "n", ""), ("0.1.0", "removed", "old", ""), ("0.1.0", "added", "new", ""), ("0.1.0", "added", "tags", "")}


def test_rare_fields_nulls_and_noise(spark):
    a = [("0.1.0", {"id": i, "x": None if i % 2 else i}) for i in range(30)]
    b = [("0.10.0", {"id": i, "x": i, **({"stray": 1} if i < 2 else {})}) for i in range(30)] + [("0.10.0", "{cut"), ("0.10.0", None), ("9.9", {"id": 1, "q": 1}), (None, {"id": 1})]
    assert got(layouts.layout_changes(rows_of(spark, a + b), migrations(spark), TRACKED)) == set()


def test_equal_flags_are_no_rename(spark):
    a = [("0.0.5", {"id": i, "flag": True}) for i in range(30)]
    b = [("0.1.0", {"id": i, "other": True}) for i in range(30)]
    found = got(layouts.layout_changes(rows_of(spark, a + b), migrations(spark), TRACKED).select("change", "field"))
    assert found == {("removed", "flag"), ("added", "other")}


def test_segments_and_deletes(spark):
    seg = [("0.1.0", ['{"op":"insert","row":{"id":1,"a":1}}', '{"op":"delete","row":{"id":1}}', '{"id":2,"a":2}'])]
    have = {(r.field, r.n) for r in layouts.layouts(rows_of(spark, [], seg)).collect()}
    assert have == {("id", 2), ("a", 2)}


def test_empty(spark):
    assert got(layouts.layout_changes(rows_of(spark, []), migrations(spark), TRACKED)) == set()


def test_one_consistent_table(spark):
    before = [("0.0.5", {"id": i, "text": f"t{i}", "n": i}) for i in range(30)]
    after = [("0.1.0", {"id": i, "body": f"t{i}", "n": str(i), "m": {"b": 1, "a": [True]}}) for i in range(30)]
    rows = rows_of(spark, before + after)
    schema = layouts.union_schema(layouts.layouts(rows), layouts.layout_changes(rows, migrations(spark), TRACKED), "messages")
    assert schema == [("body", "text", ["body", "text"]), ("id", "number", ["id"]), ("m", "object", ["m"]), ("n", "text", ["n"])]
    table = layouts.unified(layouts.keyed(rows, TRACKED), schema, "messages").where("pk = '7'").orderBy("version").collect()
    assert [tuple(r) for r in table] == [("0.0.5", "7", "t7", 7.0, None, "7"), ("0.1.0", "7", "t7", 7.0, '{"a":[true],"b":1}', "7")]


def whole_table(spark, rows):
    counts = layouts.counted(rows)
    schema = layouts.union_schema(counts, layouts.layout_changes(rows, migrations(spark), TRACKED, counts), "messages")
    return schema, layouts.unified(layouts.keyed(rows, TRACKED), schema, "messages", rest=True)


def test_rare_fields_and_kinds_stay_in_the_table(spark):
    rows = rows_of(spark, [("0.1.0", {"id": i, "n": "many" if i == 7 else i, **({"_debug": True} if i == 3 else {}), **({"it's": 1, "q?": None} if i == 4 else {})}) for i in range(40)])
    schema, table = whole_table(spark, rows)
    assert schema == [("_debug", "boolean", ["_debug"]), ("id", "number", ["id"]), ("it's", "number", ["it's"]), ("n", "text", ["n"]), ("q?", "text", ["q?"])]
    got_rows = {r.pk: r for r in table.collect()}
    assert got_rows["3"]["f__debug"] is True and got_rows["7"]["f_n"] == "many" and got_rows["8"]["f_n"] == "8" and got_rows["4"]["f_it's"] == 1.0 and got_rows["4"]["f_q?"] is None
    assert all(r["rest"] is None for r in got_rows.values())


def test_rest_holds_what_typed_columns_do_not(spark, monkeypatch):
    monkeypatch.setattr(layouts, "MOST_FIELDS", 3)
    before = [("0.0.5", {"id": i, "text": f"t{i}"}) for i in range(40)]
    after = [("0.1.0", {"id": i, "body": f"t{i}", **({"text": "other", "rare": [1]} if i == 5 else {}), **({"Body": 2} if i == 6 else {})}) for i in range(40)]
    schema, table = whole_table(spark, rows_of(spark, before + after))
    assert schema == [("body", "text", ["body", "text"]), ("id", "number", ["id"])]
    rest = {(r.version, r.pk): (r.f_body, json.loads(r.rest)) for r in table.where("rest is not null").collect()}
    assert rest == {("0.1.0", "5"): ("t5", {"text": "other", "rare": [1]}), ("0.1.0", "6"): ("t6", {"Body": 2})}
    monkeypatch.setattr(layouts, "MOST_FIELDS", 10)
    schema, table = whole_table(spark, rows_of(spark, before + after))
    assert [f for f, _, _ in schema] == ["body", "id", "rare"] and table.where("rest is not null").count() == 2


def test_skewed_flags_are_renamed_and_unrelated_ones_are_not(spark):
    a = [("0.0.5", {"id": i, "flag": i % 20 == 0, "odd": i % 20 == 1}) for i in range(200)]
    b = [("0.1.0", {"id": i, "marked": i % 20 == 0, "other": i % 20 == 2}) for i in range(200)]
    found = got(layouts.layout_changes(rows_of(spark, a + b), migrations(spark), TRACKED).select("change", "field", "new_field"))
    assert found == {("renamed", "flag", "marked"), ("removed", "odd", ""), ("added", "other", "")}
