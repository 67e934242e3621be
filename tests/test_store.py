from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pytest
from conftest import got
from pyspark.sql import functions as F

from palimpsest import approval
from palimpsest.errors import ApprovalRefused, Busy, IntegrityFailure, InvalidBranchName, InvalidInput, MissingReverseMigration, NotFound, SchemaMismatch, SecretDetected, StoreError
from palimpsest.functions import documents
from palimpsest.store import Checkpointer, MemoryBackend, PeerPolicy, Store, assemble, load_steps, git_head, parse_backend, parse_store_spec, read_prompts, write_prompts

NOW = datetime(2026, 5, 1, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), {"episodes": "id"}, approval.Gate(b"key"))
    s.init()
    return s


def episodes(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, text string")


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, text string, _op string, _at long")


def test_commit_log_diff_status(store):
    a = store.commit("main", "one", NOW, prompts={"s.txt": "hi", "rules.txt": "r"}, model="m1")
    b = store.commit("main", "two", NOW, prompts={"s.txt": "hello", "style.txt": "s"}, model="m2")
    assert [h for h, _ in store.log()] == [b, a] and store.log(limit=0) == [] and store.log(limit=1)[0][0] == b
    assert store.diff(a, b) == {"prompts": ["+ style.txt", "- rules.txt", "~ s.txt"], "model": ("m1", "m2")} and store.diff(a, a) == {}
    assert store.resolve("HEAD") == store.resolve("main") == b and store.resolve(a.upper()) == a
    assert store.status()["branches"] == {"main": b}
    with pytest.raises(NotFound):
        store.resolve("none")


def test_refused_input(store):
    for name in ("", "HEAD", "a//b", "/a", "a/../b", "x.tmp", "a\\b", "a\x01"):
        with pytest.raises(InvalidBranchName):
            store.commit(name, "m", NOW)
    with pytest.raises(SecretDetected):
        store.commit("main", "m", NOW, prompts={"a": "AKIA" + "ABCDEFGH12345678"})
    with pytest.raises(InvalidInput):
        store.commit("main", "m", NOW, memory_snapshot="x")
    assert store.branches() == {}


def test_integrity_and_dangling_refs(store):
    h = store.put("text")
    assert store.put("text") == h and store.get(h) == "text"
    store._object(h).write_text("other")
    with pytest.raises(IntegrityFailure):
        store.get(h)
    (store.root / "refs/heads/lost").write_text("0" * 64)
    with pytest.raises(IntegrityFailure):
        store.init()


def test_one_writer(store):
    with store.writing(), pytest.raises(Busy) as e:
        store.commit("main", "m", NOW)
    assert e.value.retryable and issubclass(Busy, StoreError)


def test_restore_follows_seal_order(spark, store):
    m = store.snapshot({"episodes": episodes(spark, *[(i, "x") for i in range(1, 101)])}, "0.1.0")
    m = store.append(m, {"episodes": changes(spark, (50, "x2", "update", 0))})
    m = store.append(m, {"episodes": changes(spark, (10, "p", "update", 0), (50, "y", "update", 1), (1, None, "delete", 2), (200, "n", "insert", 3))})
    rows = dict(got(store.restore(m, "episodes")))
    assert rows[50] == "y" and rows[10] == "p" and 1 not in rows and rows[200] == "n" and len(rows) == 100
    with pytest.raises(SchemaMismatch):
        store.restore(m, "episodes", "0.2.0")
    m2 = store.append(m, {"episodes": changes(spark, (None, None, "truncate", 0), (7, "seven", "insert", 1))})
    assert got(store.restore(m2, "episodes")) == {(7, "seven")}
    assert {(r.pk, r.change) for r in store.diff_rows(m, m2, "episodes").collect()} >= {(7, "modified"), (50, "removed")}


def test_snapshot_refuses_bad_rows(spark, store):
    with pytest.raises(Exception, match="null primary key in episodes.id"):
        store.snapshot({"episodes": episodes(spark, (None, "orphan"))}, "0.1.0")
    with pytest.raises(Exception, match="bad change"):
        store.append(store.put("[]"), {"episodes": changes(spark, (None, None, "delete", 0))})


def test_rollback_is_recorded_forward(spark, store, tmp_path):
    folder = str(tmp_path / "prompts")
    m1 = store.snapshot({"episodes": episodes(spark, (1, "a"))}, "0.1.0")
    a = store.commit("main", "good", NOW, prompts={"s.txt": "good"}, memory_snapshot=m1, schema_version="0.1.0")
    m2 = store.snapshot({"episodes": episodes(spark, (1, "a"), (99, "bad"))}, "0.2.0")
    b = store.commit("main", "bad", NOW, prompts={"s.txt": "bad", "x/y.txt": "z"}, memory_snapshot=m2, schema_version="0.2.0")
    write_prompts(folder, {"s.txt": "bad", "x/y.txt": "z"})
    args = {"now": NOW, "migrations": ["0.1.0", "0.2.0"], "down": {"0.2.0": lambda t, df: df.withColumnRenamed("text", "body")}, "uid": 7, "folder": folder}
    with pytest.raises(ApprovalRefused, match="approval_required"):
        store.rollback(a, **args)
    with pytest.raises(MissingReverseMigration):
        store.rollback(a, **(args | {"down": {}}))
    token = approval.issue(b"key", "reverse_migration", a, 7, int(NOW.timestamp()))
    assert store.rollback(a, token=token, dry_run=True, **args) == a and store.resolve("HEAD") == b
    c = store.rollback(a, token=token, **args)
    with pytest.raises(ApprovalRefused, match="approval_token_replayed"):
        store.rollback(a, token=token, **args)
    new = store.read_commit(c)
    assert new.parent == b and new.author == "rollback" and new.tuple_hash == store.read_commit(a).tuple_hash and c != a
    assert read_prompts(folder) == {"s.txt": "good"} and got(store.restore(new.memory_snapshot, "episodes")) == {(1, "a")}


def test_rollback_keeps_the_present_and_checks_first(spark, store, tmp_path):
    m1 = store.snapshot({"episodes": episodes(spark, (1, "a"))}, "0.1.0")
    a = store.commit("main", "good", NOW, prompts={"s.txt": "good"}, memory_snapshot=m1, schema_version="0.1.0")
    m2 = store.snapshot({"episodes": episodes(spark, (1, "a"), (99, "bad")).withColumn("n", F.lit(1))}, "0.2.0")
    store.commit("main", "bad", NOW, memory_snapshot=m2, schema_version="0.2.0")
    args = {"now": NOW, "migrations": ["0.1.0", "0.2.0"], "down": {"0.2.0": lambda t, df: df.drop("n")}, "uid": 7, "token": approval.issue(b"key", "reverse_migration", a, 7, int(NOW.timestamp()))}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/s.txt").symlink_to(tmp_path / "elsewhere")
    with pytest.raises(InvalidInput, match="symbolic link"):
        store.rollback(a, folder=str(tmp_path / "p"), **args)
    paused = []

    class Feed:
        @contextmanager
        def paused(self):
            paused.append(store.status()["writing"])
            yield

    c = store.rollback(a, capture=Feed(), keep_present=True, **args)
    assert paused == [True] and got(store.restore(store.present_before(c), "episodes", "0.1.0")) == {(1, "a"), (99, "bad")}
    with pytest.raises(NotFound):
        store.present_before(a)
    bare = store.commit("old", "no tables", NOW, schema_version="0.1.0")
    store.commit("main", "again", NOW, memory_snapshot=m2, schema_version="0.2.0")
    token = approval.issue(b"key", "reverse_migration", bare, 7, int(NOW.timestamp()))
    new = store.read_commit(store.rollback(bare, **(args | {"token": token})))
    assert got(store.restore(new.memory_snapshot, "episodes", "0.1.0")) == {(1, "a"), (99, "bad")} and new.schema_version == "0.1.0"


def test_refs_are_frozen(store):
    a = store.commit("x/y", "one", NOW)
    refs = store.refs()
    b = store.commit("x/y", "two", NOW)
    assert store.resolve("HEAD", refs) == a and store.resolve("x/y") == b and refs.head == "x/y"
    with pytest.raises(TypeError):
        refs.branches["z"] = a


def test_memory_backend(store):
    m = MemoryBackend(store)
    m.insert_rows("messages", [{"id": 1, "body": "clean"}])
    m.apply_migration("001")
    snap = m.snapshot()
    m.insert_rows("messages", [{"id": 99, "body": "bad"}])
    m.insert_rows("other", [{"id": 1}])
    m.apply_migration("002")
    assert m.migrations_after("0.0.0") == ["002", "001"] and m.migrations_after("001") == ["002"]
    with pytest.raises(NotFound):
        m.migrations_after("9")
    with pytest.raises(SchemaMismatch):
        m.restore(snap)
    with pytest.raises(MissingReverseMigration):
        m.apply_reverse_migrations([("002", lambda t, r: []), ("000", lambda t, r: r)])
    assert m.version == "002" and len(m.rows_of("messages")) == 2
    m.apply_reverse_migrations([("002", lambda t, r: r)])
    m.restore(snap)
    assert m.rows_of("messages") == [{"id": 1, "body": "clean"}] and m.rows_of("other") == []


def test_error_classes():
    from palimpsest import errors

    assert errors.classify(Busy("x")) == ("concurrency", "writer_active", True) and errors.classify(errors.ObjectNotFound("x"))[1] == "object_not_found"
    try:
        try:
            raise SchemaMismatch("t")
        except SchemaMismatch as e:
            raise RuntimeError("outer") from e
    except RuntimeError as e:
        assert errors.classify(e) == ("memory", "schema_mismatch", False)
    for error, code in ((OSError("No space left on device"), "io_failure"), (ValueError("x"), "serialization_failure"), (KeyError("x"), "unclassified"), (RuntimeError("[PATH_NOT_FOUND] x"), "object_not_found"), (TimeoutError(), "io_failure")):
        assert errors.classify(error)[1] == code


def test_assembled_commits(store):
    args = assemble("main", "m", {"prompts": {"a": "b"}, "author": None, "intent": "x"}, None, None, {}, 7)
    c = store.read_commit(store.commit(now=NOW, **args))
    assert (c.author, c.peer_uid, c.memory_snapshot, set(c.prompts)) == ("unknown", 7, None, {"a"})


def test_tool_manifests():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from palimpsest.sources import manifests

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            deep = "[" * 40 + "]" * 40
            body = {"/ok": '{"result":{"tools":[{"b":1.50,"a":[2]}]}}', "/none": "{}", "/deep": f'{{"result":{deep}}}', "/big": '{"result":"' + "x" * 2**20 + '"}', "/bad": "nonsense"}.get(self.path)
            self.send_response(302 if body is None else 200)
            self.send_header("Location", "/ok")
            self.send_header("Content-Length", str(len(body or "")))
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        names = ["ok", "none", "deep", "big", "bad", "moved", "ok"]
        found = manifests.fingerprint_all(manifests.parse_spec([f"s{k}={base}/{n}" for k, n in enumerate(names)]))
        assert [m.name for m in found] == [f"s{k}" for k in range(7)]
        assert found[0].text == '{"tools":[{"a":[2],"b":1.50}]}' or json.loads(found[0].text) == {"tools": [{"a": [2], "b": 1.5}]}
        assert found[0].hash == found[6].hash and all(m.failure and m.text is None for m in found[1:6])
    finally:
        server.shutdown()
    for bad in ("x", "=http://localhost", "a=http://example.org/x", "a=ftp://localhost"):
        with pytest.raises(InvalidInput):
            manifests.parse_spec([bad])
    with pytest.raises(InvalidInput):
        manifests.parse_spec(["a=https://x", "a=https://y"])


def test_prompt_files_of_a_shared_folder(spark, tmp_path):
    from palimpsest.sources import prompt_files

    for name, text in (("a.txt", "one"), ("sub dir/b+c.md", "zwei ü"), ("sub dir/x/empty", "")):
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    assert got(prompt_files(spark, str(tmp_path / "p"))) == {("a.txt", "one", 3), ("sub dir/b+c.md", "zwei ü", 7), ("sub dir/x/empty", "", 0)}


def test_approval_tokens():
    t = approval.issue(b"k", "reverse_migration", "AB" * 32, 5, 1000)
    assert approval.verify(b"k", ("reverse_migration",), "ab" * 32, 5, t, 1300)[0] == "reverse_migration"
    for scopes, uid, token, now, code in (
        (("data_loss",), 5, t, 1000, "invalid_signature"), (("reverse_migration",), 6, t, 1000, "invalid_signature"), (("reverse_migration",), 5, t, 1301, "expired"), (("reverse_migration",), 5, t, 699, "expired"), (("reverse_migration",), 5, "x", 1000, "malformed"), (("reverse_migration",), 5, "1000:ab", 1000, "malformed"),
    ):
        with pytest.raises(ApprovalRefused, match=code):
            approval.verify(b"k", scopes, "ab" * 32, uid, token, now)
    gate = approval.Gate(None)
    with pytest.raises(ApprovalRefused, match="key_not_configured"):
        gate.check("a", 1, "t", False, 0)
    assert gate.audit == [("approval_key_not_configured", "t")]


def test_checkpointer(store):
    c = Checkpointer(store)
    assert c.get("t") is None and c.list("t") == []
    c.put("t", ("msgpack", b"\x01"), ("bytes", b"m"), NOW)
    c.put("t", ("msgpack", b"\x02"), ("bytes", b"m"), NOW + timedelta(seconds=1))
    assert c.get("t") == (("msgpack", b"\x02"), ("bytes", b"m")) and len(c.list("t")) == 1
    text = documents.encode_checkpoint("t", ("pickle", b""), ("bytes", b""))
    for bad in (text, text.replace('"v": 1', '"v": 99')):
        with pytest.raises(ValueError):
            documents.decode_checkpoint(bad)


def test_prompt_folder(tmp_path):
    assert read_prompts(str(tmp_path / "none")) == {}
    folder = tmp_path / "p"
    write_prompts(str(folder), {"a/b.txt": "1", "c.txt": "2"})
    write_prompts(str(folder), {"c.txt": "3"})
    assert read_prompts(str(folder)) == {"c.txt": "3"}
    for wanted in ({"../x": ""}, {"/x": ""}, {"a": "", "A/b": ""}):
        with pytest.raises(InvalidInput):
            write_prompts(str(folder), wanted)
    (folder / "link").symlink_to(tmp_path)
    with pytest.raises(InvalidInput):
        write_prompts(str(folder), {"link/x": "1"})


def test_specs(tmp_path):
    assert parse_store_spec("fs", "/d") == {"kind": "fs", "root": "/d/objects", "uri": "/d/objects"} and parse_store_spec("fs:///x", "/d")["root"] == "/x"
    assert parse_store_spec("gcs://b/p/", "/d") == {"kind": "gcs", "bucket": "b", "prefix": "p", "uri": "gs://b/p"}
    for bad in ("fs://rel", "gcs:///p", "s3://x"):
        with pytest.raises(InvalidInput):
            parse_store_spec(bad, "/d")
    assert parse_backend(None, [])["kind"] == "none" and parse_backend("u", ["t:id"])["tables"] == [("t", "id")]
    with pytest.raises(InvalidInput):
        parse_backend("u", [])
    assert git_head(str(tmp_path)) is None


def test_reverse_migrations(spark, store, tmp_path):
    m = store.snapshot({"episodes": episodes(spark, (1, "a"), (2, None))}, "0.2.0")
    back = store.reverse_migrate(m, [("0.2.0", lambda t, df: df.withColumn("n", F.lit(1))), ("0.1.0", lambda t, df: df.drop("text"))], "0.0.0")
    assert got(store.restore(back, "episodes", "0.0.0")) == {(1, 1), (2, 1)}
    with pytest.raises(MissingReverseMigration):
        store.reverse_migrate(m, [("0.2.0", lambda t, df: df.drop("id"))], "0.1.0")
    (tmp_path / "a.down.sql").write_text("\n -- IRREVERSIBLE\n")
    (tmp_path / "b.down.sql").write_text("drop table t;\n-- IRREVERSIBLE")
    assert [n for n, _ in load_steps(str(tmp_path), ["b"])] == ["b"] and load_steps(str(tmp_path), ["a"], accept_data_loss=True)
    for bad in (["a"], ["c"]):
        with pytest.raises(MissingReverseMigration):
            load_steps(str(tmp_path), bad)
    with pytest.raises(InvalidInput):
        load_steps(str(tmp_path), ["../a"])


def test_peers():
    assert PeerPolicy(frozenset({5})).is_allowed(5) and not PeerPolicy(frozenset({5})).is_allowed(6) and PeerPolicy(frozenset({5})).attested(5) == 5
    assert PeerPolicy().is_allowed(0) and PeerPolicy().attested(0) is None


def test_json_documents(spark):
    assert documents.canonical_text('{"b":2,"a":{"y":1.50,"x":[3,2,1e2]}}') == '{"a":{"x":[3,2,1e2],"y":1.50},"b":2}'
    assert documents.canonical_text("{cut") is None and documents.canonical_text(None) is None
    assert [documents.depth_of(x) for x in ("1", "[]", "[[]]", '{"a":{"b":[1]}}', "", None)] == [1, 1, 2, 4, None, None]
    df = spark.createDataFrame([("[[]]",), (None,), ("x",)], "s string").select(documents.json_depth("s").alias("d"), documents.canonical_json("s").alias("c"))
    assert [tuple(r) for r in df.collect()] == [(2, "[[]]"), (None, None), (None, None)]
    assert documents.branch_of_thread("t").startswith("thread/") and len(documents.branch_of_thread("t")) == 23


def test_forward_record(spark):
    from palimpsest.operators.restoring import forward_record

    c = spark.createDataFrame([("a", "s", "m", "x", "1", {"p": "q"}, None), ("b", None, None, None, None, None, None)], "commit_hash string, code_sha string, model string, memory_snapshot string, schema_version string, prompts map<string,string>, tools map<string,string>")
    r = forward_record(c, c.where("commit_hash = 'b'").select("commit_hash"), c.where("commit_hash = 'a'").select("commit_hash"), "rollback", "2026-01-01 00:00:00").select("parent", "model", "message", F.length("commit_hash")).first()
    assert tuple(r) == ("b", "m", "rollback to a", 64)
