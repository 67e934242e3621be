from datetime import datetime as D

import brute
from conftest import got

from palimpsest.functions.names import Tracked
from palimpsest.operators import snapshots
from palimpsest.plans.core_found import p4_found, p4_values

TRACKED = [Tracked("messages", "id")]
MAN = "manifest string, workspace string, schema_version string, taken_at timestamp, stored_at timestamp, entries array<struct<table_name:string,pk_lo:string,pk_hi:string,segment:string,row_count:bigint>>, pk string, change string"
SEG = "segment string, table_name string, rows array<string>, n_rows int, items string"


def diff(spark, manifests, segments):
    m = spark.createDataFrame([(h, "w", v, D(2026, 1, day), D(2026, 1, day), e if e is None else [("messages", "", "", s, n) for s, n in e], None, None) for h, v, day, e in manifests], MAN)
    s = spark.createDataFrame([(h, "messages", r, 0, None) for h, r in segments], SEG)
    return got(snapshots.diff_snapshots(m, s, TRACKED).select("manifest", "pk", "change"))


def test_added_removed_changed_by_value(spark):
    segments = [
        ("S1", ['{"op":"insert","row":{"id":1,"a":1.50,"b":null}}', '{"id":2,"a":"x"}', '{"id":3}']),
        ("s2", ['{"a":15e-1,"id":"1"}', '{"op":"insert","row":{"id":2,"a":"y"}}', '{"id":4,"m":{"p":1,"q":[1,2]}}']),
        ("s3", ['{"id":1,"a":1.5}', '{"id":2,"a":"\\u0079"}', '{"id":4,"m":{"q":[1,2.0],"p":1}}', '{"op":"delete","row":{"id":1}}']),
    ]
    assert diff(spark, [("M1", "1", 1, [("s1", 3)]), ("m2", "1", 2, [("S2 ", 3)]), ("m3", " v1", 3, [("s3", 4)])], segments) == {("m2", "2", "changed"), ("m2", "3", "removed"), ("m2", "4", "added"), ("m3", "1", "removed")}


def test_incomplete_are_passed_over_and_versions_not_compared(spark):
    segments = [("a", ['{"id":1}']), ("b", ['{"id":2}', '{"id":3}']), ("c", None), ("b", ['{"id":2}'])]
    manifests = [("m1", "1", 1, [("a", 1)]), ("m2", "1", 2, [("b", 1)]), ("m3", "1", 3, [("missing", 1)]), ("m4", "1", 4, [("c", 1)]), ("m5", "1", 5, [("b", 2)]), ("m6", "2", 6, [("a", 1)]), ("m7", "2", 7, [])]
    assert diff(spark, manifests, segments) == {("m5", "1", "removed"), ("m5", "2", "added"), ("m5", "3", "added"), ("m7", "1", "removed")}


def test_repeated_rows_and_entries(spark):
    segments = [("a", ['{"id":1}', "{broken", None, '{"id":null}'])] * 2
    assert diff(spark, [("m1", "1", 1, []), ("m2", "1", 2, [("a", 4), ("a", 4)]), ("m2", "1", 2, [("a", 4), ("a", 4)])], segments) == {("m2", "1", "added")}


def test_empty_and_null(spark):
    assert diff(spark, [], []) == set()
    assert diff(spark, [("m1", "1", 1, None), (None, "1", 2, [("a", 1)])], [(None, ['{"id":1}'])]) == set()


def test_long_value(spark):
    segments = [("a", ['{"id":1,"t":"%s"}' % ("x" * 500_000)]), ("b", ['{"id":1,"t":"%sy"}' % ("x" * 500_000)])]
    assert diff(spark, [("m1", "1", 1, [("a", 1)]), ("m2", "1", 2, [("b", 1)])], segments) == {("m2", "1", "changed")}


def test_against_brute_force(spark, small):
    assert got(p4_found(spark, small)) == brute.p4(small)


def test_values_are_those_of_the_places(spark, small):
    rows = p4_values(spark, small).collect()
    assert rows
    for r in rows:
        assert (r.old_row is None) == (r.change == "added") and (r.new_row is None) == (r.change == "removed")
        for text in filter(None, (r.old_row, r.new_row)):
            x = brute.load(text)
            x = x["row"] if "row" in x else x
            assert r.pk in {brute.key(v) for v in x.values()}


def naive(manifests, segments):
    """Whole snapshots one after the other, by plain Python."""
    import json

    held, state, out = dict(segments), None, set()
    for name, version, _, entries in sorted(manifests, key=lambda m: m[2]):
        rows = {}
        if any(len(held.get(s, ())) != n for s, n in entries):
            continue
        for s, _ in entries:
            for x in map(json.loads, held[s]):
                rows[str(x["row"]["id"])] = (x["op"], x["row"].get("v"))
        rows = {k: v for k, (op, v) in rows.items() if op != "delete"}
        if state is not None and state[0] == version:
            out |= {(name, k, "added") for k in rows.keys() - state[1].keys()} | {(name, k, "removed") for k in state[1].keys() - rows.keys()}
            out |= {(name, k, "changed") for k in rows.keys() & state[1].keys() if rows[k] != state[1][k]}
        state = version, rows
    return out


def made(seed, n=14):
    """Snapshots that share, reorder, repeat, drop and bring back segments with overlapping keys."""
    import json
    import random

    r = random.Random(seed)
    segments = [(f"s{k:02}", [json.dumps({"op": "delete" if r.random() < 0.15 else "insert", "row": {"id": r.randrange(12), "v": r.randrange(3)}}) for _ in range(r.randrange(1, 5))]) for k in range(8)]
    size = {s: len(rows) for s, rows in segments}
    manifests, now = [], ["s00", "s01", "s02"]
    for k in range(n):
        now = [x for x in now if r.random() > 0.25] + ([r.choice(segments)[0]] if r.random() < 0.8 else [])
        if r.random() < 0.3:
            r.shuffle(now)
        manifests.append((f"m{k:02}", "2" if k > 10 else "1", k + 1, [(s, size[s] + (r.random() < 0.05)) for s in now]))
    return manifests, segments


def test_index_against_whole_snapshots(spark):
    for seed in range(4):
        manifests, segments = made(seed)
        assert diff(spark, manifests, segments) == naive(manifests, segments) != set()


def frames(spark, manifests, segments):
    m = spark.createDataFrame([(h, "w", v, D(2026, 1, day), D(2026, 1, day), [("messages", "", "", s, n) for s, n in e], None, None) for h, v, day, e in manifests], MAN)
    return m, spark.createDataFrame([(h, "messages", r, 0, None) for h, r in segments], SEG)


def test_a_stored_index_takes_the_place_of_the_first_snapshot(spark, monkeypatch):
    manifests, segments = made(3)
    manifests = [m for m in manifests if all(len(dict(segments)[s]) == n for s, n in m[3])]
    cut_at = 4
    index = snapshots.last_index(*frames(spark, manifests[:cut_at], segments), TRACKED)
    assert index.dtypes == spark.createDataFrame([], snapshots.INDEX).dtypes
    parsed = []
    real = snapshots.segment_index
    monkeypatch.setattr(snapshots, "segment_index", lambda s, t: parsed.append({r.segment for r in s.select("segment").collect()}) or real(s, t))
    later = got(snapshots.diff_snapshots(*frames(spark, manifests[cut_at - 1 :], segments), TRACKED, index).select("manifest", "pk", "change"))
    assert later == {x for x in naive(manifests, segments) if x[0] >= manifests[cut_at][0]} != set()
    first = {(s, k) for k, (s, _) in enumerate(manifests[cut_at - 1][3])}
    assert parsed[0] == {s for m in manifests[cut_at:] for k, (s, _) in enumerate(m[3]) if (s, k) not in first} | (parsed[0] & {s for s, _ in first})


def test_shared_segments_are_one_run(spark):
    segments = [(f"s{k}", [f'{{"id":{k}}}']) for k in range(5)]
    manifests = [(f"m{d}", "1", d, [(f"s{k}", 1) for k in range(4)] + ([("s4", 1)] if d > 3 else [])) for d in range(1, 7)]
    m, _ = frames(spark, manifests, segments)
    snaps, entries = snapshots.snapshot_tables(m, TRACKED)
    seqs = snapshots.complete_snapshots(snaps, entries, spark.createDataFrame([(f"s{k}", 1) for k in range(5)], "segment string, n_rows long"), TRACKED)
    assert got(snapshots.segment_runs(seqs, entries).select("segment", "a", "b")) == {*((f"s{k}", 1, None) for k in range(4)), ("s4", 4, None)}
