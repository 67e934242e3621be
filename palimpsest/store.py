"""A version store on Parquet: segments, trees and commits behind refs that are swapped atomically.

Everything is written under new paths first; the replacement of one ref file publishes it. The folder is one that driver
and executors share, on any file system that Hadoop knows.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager, nullcontext
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from hashlib import sha256
from pathlib import Path
from types import MappingProxyType
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .approval import Gate
from .errors import Busy, IntegrityFailure, InvalidBranchName, InvalidInput, MissingReverseMigration, NotFound, SchemaMismatch, SecretDetected
from .functions.scalars import ENTROPY_THRESHOLD, RUN, TOKEN_PATTERNS
from .operators.folds import finite, refuse
from .operators.trees import diff_entries
from .shared import SharedPath

_HASH = re.compile(r"[0-9a-fA-F]{64}")
_BRANCH = re.compile(r"(?!HEAD$)(?!.*(?:^|/)(?:\.{0,2}|[^/]*\.tmp)(?:/|$))[^\\\x00-\x1f\x7f-\x9f]+")
#: Objects beyond this size are not printed.
MOST_BYTES = 10 * 2**20


def replace_text(path: Path, text: str) -> None:
    """Write a small file whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_name(f"{path.name}.{uuid.uuid4().hex}.tmp")
    temp.write_text(text)
    os.replace(temp, path)


def write_segment(rows: DataFrame, root: str, table: str, seal_seq: int) -> str:
    """Rows as an immutable Parquet folder under a new name; its path."""
    path = f"{root}/table={table}/seal_seq={seal_seq}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def parse_store_spec(spec: str, default: str) -> dict[str, str]:
    """fs, fs:///absolute or gcs://bucket[/prefix]; uri is what Store takes (an object store needs its connector on the class path)."""
    spec = spec.strip()
    if spec in ("", "fs"):
        return {"kind": "fs", "root": f"{default}/objects", "uri": f"{default}/objects"}
    if spec.startswith("fs://"):
        if not spec[5:].startswith("/"):
            raise InvalidInput(f"fs:// needs an absolute path: {spec!r}")
        return {"kind": "fs", "root": spec[5:], "uri": f"file://{spec[5:]}"}
    if spec.startswith("gcs://"):
        bucket, _, prefix = spec[6:].partition("/")
        if not bucket:
            raise InvalidInput(f"gcs:// needs a bucket: {spec!r}")
        return {"kind": "gcs", "bucket": bucket, "prefix": prefix.strip("/"), "uri": f"gs://{bucket}/{prefix.strip('/')}".rstrip("/")}
    raise InvalidInput(f"unknown store {spec!r}")


def parse_backend(url: str | None, tables: list[str]) -> dict[str, object]:
    """No URL: no tables are versioned. With one, at least one table:key."""
    if url is None:
        return {"kind": "none"}
    if not tables:
        raise InvalidInput("a backend needs at least one table")
    return {"kind": "jdbc", "url": url, "tables": [tuple(t.rsplit(":", 1)) for t in tables]}


def git_head(folder: str) -> str | None:
    """The commit of a working copy; best effort."""
    try:
        done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def read_prompts(folder: str) -> dict[str, str]:
    """Relative names and texts of regular files; a missing folder is empty, links are not followed."""
    root = Path(folder)
    return {str(p.relative_to(root)): p.read_text() for p in sorted(root.rglob("*")) if p.is_file() and not p.is_symlink()} if root.is_dir() else {}


def check_prompts(folder: str, wanted: dict[str, str]) -> None:
    """Refuse unsafe names, a name that is both file and directory, and paths through symbolic links."""
    root = Path(folder)
    lower = sorted([p.lower() for p in Path(n).parts] for n in wanted)
    for n in wanted:
        if not n or n.startswith("/") or ".." in Path(n).parts or n.startswith("./"):
            raise InvalidInput(f"unsafe name {n!r}")
        target = root / n
        if any(p.is_symlink() for p in [target, *target.parents] if p != root and root in p.parents):
            raise InvalidInput(f"{n!r} passes a symbolic link")
    if any(len(b) > len(a) and b[: len(a)] == a for a, b in zip(lower, lower[1:])):
        raise InvalidInput("a name is both a file and a directory")


def write_prompts(folder: str, wanted: dict[str, str]) -> None:
    """Write all wanted files, delete the rest; what check_prompts() refuses is refused before anything is written."""
    check_prompts(folder, wanted)
    root = Path(folder)
    for n, text in wanted.items():
        replace_text(root / n, text)
    for n in read_prompts(folder).keys() - wanted.keys():
        (root / n).unlink()


def load_steps(folder: str, names: list[str], accept_data_loss: bool = False) -> list[tuple[str, str]]:
    """(name, SQL) of the reverse migrations, newest first as given; unsafe names, missing files and irreversible steps are refused."""
    out = []
    for n in names:
        if "/" in n or "\\" in n or ".." in n:
            raise InvalidInput(f"migration name {n!r}")
        path = Path(folder) / f"{n}.down.sql"
        if not path.is_file():
            raise MissingReverseMigration(n)
        sql = path.read_text()
        first = next((x.strip() for x in sql.splitlines() if x.strip()), "")
        if first.startswith("-- IRREVERSIBLE") and not accept_data_loss:
            raise MissingReverseMigration(f"{n} is irreversible")
        out.append((n, sql))
    return out


@dataclass(frozen=True)
class PeerPolicy:
    """Who may write: a list of user ids, or anyone, in which case no id is attested."""

    allowed: frozenset[int] | None = None

    def is_allowed(self, uid: int) -> bool:
        return self.allowed is None or uid in self.allowed

    def attested(self, uid: int) -> int | None:
        return None if self.allowed is None else uid


def scan_text(text: str, skip_entropy: bool = False) -> list[str]:
    """Kinds of secret in one small text; operators.scanning does it for tables."""
    from math import log2

    hits = [k for k, p in TOKEN_PATTERNS.items() if re.search(p, text)]
    for run in [] if skip_entropy else re.findall(RUN, text):
        if -sum(n / len(run) * log2(n / len(run)) for n in map(run.count, set(run))) > ENTROPY_THRESHOLD:
            hits.append("high_entropy")
            break
    return hits


@dataclass(frozen=True)
class Commit:
    """The six dimensions and their metadata; the id covers all of it, tuple_hash the dimensions alone."""

    parent: str | None
    author: str
    message: str
    committed_at: str
    code_sha: str | None = None
    prompts: dict[str, str] = field(default_factory=dict)  # name -> hash of its text
    tools: dict[str, str] = field(default_factory=dict)
    model: str | None = None
    memory_snapshot: str | None = None
    schema_version: str | None = None
    peer_uid: int | None = None

    @property
    def hash(self) -> str:
        return sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    @property
    def tuple_hash(self) -> str:
        dims = {k: v for k, v in asdict(self).items() if k in ("code_sha", "prompts", "tools", "model", "memory_snapshot", "schema_version")}
        return sha256(json.dumps(dims, sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Refs:
    """A frozen copy of the refs; consistent with what a writer does while it holds the lock."""

    head: str | None
    branches: Mapping[str, str]


class Store:
    """Versioned tables and texts under one folder."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str] | None = None, gate: Gate | None = None, exempt: tuple[str, ...] = (), allowed: frozenset[str] = frozenset()) -> None:
        for p in exempt:
            if not p or p != p.strip() or p.startswith("/") or not p.endswith("/"):
                raise InvalidInput(f"exempt prefix {p!r}")
        self.spark, self.root, self.keys, self.gate = spark, SharedPath(spark, root), keys or {}, gate or Gate(None)
        self.exempt, self.allowed = exempt, allowed

    def init(self) -> None:
        for d in ("objects", "segments", "manifests", "refs/heads"):
            (self.root / d).mkdir()
        dangling = [b for b, h in self.branches().items() if not self._object(h).exists()]
        if dangling:
            raise IntegrityFailure(f"branches without their commit: {dangling}")

    @contextmanager
    def writing(self) -> Iterator[None]:
        """One writer at a time."""
        lock = self.root / "lock"
        if not lock.create():
            raise Busy("another writer is active")
        try:
            yield
        finally:
            lock.remove()

    # objects and refs: small files, written by the driver to the shared folder

    def _object(self, h: str) -> SharedPath:
        return self.root / f"objects/{h[:2]}/{h[2:]}"

    def put(self, text: str) -> str:
        h = sha256(text.encode()).hexdigest()
        if not self._object(h).exists():
            self._object(h).write_text(text)
        return h

    def get(self, h: str) -> str:
        path = self._object(h)
        if not path.exists():
            raise NotFound(h)
        text = path.read_text()
        if sha256(text.encode()).hexdigest() != h:
            raise IntegrityFailure(h)
        return text

    def cat(self, h: str) -> str:
        if self._object(h).exists() and self._object(h).size() > MOST_BYTES:
            raise InvalidInput("object too large")
        return self.get(h)

    def refs(self) -> Refs:
        """HEAD and all branches, read once."""
        path = self.root / "HEAD"
        return Refs(path.read_text() if path.exists() else None, MappingProxyType({name: p.read_text() for name, p in (self.root / "refs/heads").files()}))

    def branches(self) -> dict[str, str]:
        return dict(self.refs().branches)

    def head(self) -> str | None:
        return self.refs().head

    def resolve(self, name: str, refs: Refs | None = None) -> str:
        """HEAD, a 64-digit hash (not looked up) or a branch."""
        refs = refs or self.refs()
        if name == "HEAD":
            name = refs.head if refs.head is not None else ""
        if _HASH.fullmatch(name):
            return name.lower()
        if name not in refs.branches:
            raise NotFound(name)
        return refs.branches[name]

    def read_commit(self, h: str) -> Commit:
        return Commit(**json.loads(self.get(h)))

    # tables

    def _segments(self, manifest: str | None) -> list[dict]:
        return json.loads(self.get(manifest)) if manifest else []

    def snapshot(self, tables: dict[str, DataFrame], schema_version: str) -> str:
        """Full segments of the tables and their manifest; null keys and non-finite values are refused before anything is visible."""
        refs = []
        for seq, (name, df) in enumerate(sorted(tables.items())):
            pk = self.keys[name]
            rows = refuse(finite(df, name), F.col(pk).isNull(), F.lit(f"null primary key in {name}.{pk}"))
            n = self.spark.sparkContext.defaultParallelism
            path = write_segment(rows.repartitionByRange(n, pk).sortWithinPartitions(pk).withColumn("_op", F.lit("insert")).withColumn("_at", F.monotonically_increasing_id()), f"{self.root}/segments", name, seq)
            r = self.spark.read.parquet(path).agg(F.min(pk).cast("string"), F.max(pk).cast("string"), F.count("*")).first()
            refs.append({"table": name, "path": path, "seal_seq": seq, "pk_lo": r[0], "pk_hi": r[1], "event_count": r[2], "schema_version": schema_version})
        return self.put(json.dumps(refs, sort_keys=True))

    def append(self, manifest: str, changes: dict[str, DataFrame]) -> str:
        """A manifest with one more segment per table; changes have the table's columns, `_op` and `_at` (order)."""
        refs = self._segments(manifest)
        seq = max((r["seal_seq"] for r in refs), default=-1) + 1
        version = refs[-1]["schema_version"] if refs else "0.0.0"
        for name, df in sorted(changes.items()):
            pk = self.keys[name]
            bad = ~F.coalesce(F.col("_op").isin("insert", "update", "delete", "truncate"), F.lit(False)) | (F.col(pk).isNull() & (F.col("_op") != "truncate"))
            path = write_segment(refuse(df, bad, F.lit(f"bad change of {name}")), f"{self.root}/segments", name, seq)
            r = self.spark.read.parquet(path).agg(F.min(pk).cast("string"), F.max(pk).cast("string"), F.count("*")).first()
            refs.append({"table": name, "path": path, "seal_seq": seq, "pk_lo": r[0], "pk_hi": r[1], "event_count": r[2], "schema_version": version})
            seq += 1
        return self.put(json.dumps(refs, sort_keys=True))

    def restore(self, manifest: str, table: str, schema_version: str | None = None) -> DataFrame:
        """The live rows of a table under a manifest: its segments folded by (seal_seq, place), last writer wins.

        Each segment carries its seal_seq, so order never depends on key ranges or files. `truncate` empties the table.
        """
        refs = [r for r in self._segments(manifest) if r["table"] == table]
        if schema_version is not None and any(r["schema_version"] != schema_version for r in refs):
            raise SchemaMismatch(table)
        if not refs:
            raise NotFound(table)
        pk = self.keys[table]
        scan = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/segments").parquet(*[r["path"] for r in refs])
        out = scan.withColumn("_seal", F.split_part("seal_seq", F.lit("-"), F.lit(1)).cast("long")).drop("table", "seal_seq")
        cut = out.where("_op = 'truncate'").agg(F.max(F.struct("_seal", "_at")).alias("t"))
        rest = [c for c in out.columns if c != pk]
        last = out.where("_op <> 'truncate'").groupBy(pk).agg(F.max_by(F.struct(*rest), F.struct("_seal", "_at")).alias("e"))
        kept = last.crossJoin(F.broadcast(cut)).where("e._op <> 'delete' and (t is null or struct(e._seal, e._at) > t)")  # cut: one row
        return kept.select(pk, *[F.col(f"e.{c}").alias(c) for c in rest if c not in ("_op", "_at", "_seal")])

    def reverse_migrate(self, manifest: str, steps: list[tuple[str, Callable[[str, DataFrame], DataFrame]]], version: str) -> str:
        """A manifest of all tables after the steps (newest first), as full segments under `version`; staged, nothing is published."""
        tables = {t: self.restore(manifest, t) for t in sorted({r["table"] for r in self._segments(manifest)})}
        for name, step in steps:
            tables = {t: step(t, df) for t, df in tables.items()}
            for t, df in tables.items():
                if self.keys[t] not in df.columns:
                    raise MissingReverseMigration(f"{name} loses the key of {t}")
        return self.snapshot(tables, version)

    def diff_rows(self, old: str, new: str, table: str) -> DataFrame:
        """(pk, change, from, to): rows of a table that differ between two manifests, values as JSON."""
        pk = self.keys[table]
        side = [self.restore(m, table).select(F.col(pk).alias("pk"), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("row")) for m in (old, new)]
        return diff_entries(side[0], side[1], ["pk"], "row")

    # commits

    def commit(self, branch: str, message: str, now: datetime, author: str = "unknown", prompts: dict[str, str] | None = None, tools: dict[str, str] | None = None, model: str | None = None, code_sha: str | None = None, memory_snapshot: str | None = None, schema_version: str | None = None, peer_uid: int | None = None) -> str:
        """Scan, write objects, write the commit, swap the ref. The first commit sets HEAD."""
        if not _BRANCH.fullmatch(branch):
            raise InvalidBranchName(branch)
        if memory_snapshot and not schema_version:
            raise InvalidInput("a snapshot needs its schema version")
        for name, text in {**(prompts or {}), **(tools or {})}.items():
            kinds = [] if sha256(text.encode()).hexdigest() in self.allowed else scan_text(text, name.startswith(self.exempt) if self.exempt else False)
            if kinds:
                raise SecretDetected(f"{name}: {kinds}")
        with self.writing():
            trees = [{n: self.put(t) for n, t in sorted((x or {}).items())} for x in (prompts, tools)]
            c = Commit(self.refs().branches.get(branch), author, message, now.isoformat(), code_sha, trees[0], trees[1], model, memory_snapshot, schema_version, peer_uid)
            return self._publish(branch, c)

    def _publish(self, branch: str, c: Commit) -> str:
        h = self.put(json.dumps(asdict(c), sort_keys=True))
        (self.root / f"refs/heads/{branch}").write_text(h)
        if not (self.root / "HEAD").exists():
            (self.root / "HEAD").write_text(branch)
        return h

    def log(self, start: str = "HEAD", limit: int = 20) -> list[tuple[str, Commit]]:
        """Newest first along parents; a missing commit is an error."""
        out, at = [], self.resolve(start) if limit else None
        while at is not None and len(out) < limit:
            c = self.read_commit(at)
            out.append((at, c))
            at = c.parent
        return out

    def diff(self, old: str, new: str) -> dict[str, list[str] | tuple]:
        """Changes of the six dimensions, trees as lines."""
        refs = self.refs()
        a, b = self.read_commit(self.resolve(old, refs)), self.read_commit(self.resolve(new, refs))
        out: dict[str, list[str] | tuple] = {}
        for t in ("prompts", "tools"):
            x, y = getattr(a, t), getattr(b, t)
            lines = [f"+ {n}" for n in sorted(y.keys() - x.keys())] + [f"- {n}" for n in sorted(x.keys() - y.keys())] + [f"~ {n}" for n in sorted(x.keys() & y.keys()) if x[n] != y[n]]
            if lines:
                out[t] = lines
        for d in ("code_sha", "model", "memory_snapshot", "schema_version"):
            if getattr(a, d) != getattr(b, d):
                out[d] = (getattr(a, d), getattr(b, d))
        return out

    def status(self) -> dict[str, object]:
        refs = self.refs()
        return {"head": refs.head, "branches": dict(refs.branches), "writing": (self.root / "lock").exists()}

    # rollback

    def rollback(self, target: str, now: datetime, migrations: list[str] | None = None, down: dict[str, Callable[[str, DataFrame], DataFrame]] | None = None, irreversible: frozenset[str] = frozenset(), accept_data_loss: bool = False, token: str | None = None, uid: int | None = None, dry_run: bool = False, folder: str | None = None, capture: Quiesceable | None = None, keep_present: bool = False) -> str:
        """Return to a commit's state and record that as a new commit on the current branch.

        migrations: names applied, oldest first; those after the target's version are undone, newest first, by `down` (table
        name and rows to rows). Undoing migrations or accepting data loss needs an approval token. Everything is checked
        before anything is written. The target's tables come from its own snapshot, in its own layout, so undoing moves no
        rows; where the target has no snapshot, the present tables in its layout become the new commit's. With
        `keep_present` the present tables in the target's layout are kept as well, as the manifest that present_before()
        names, so that what the rollback took back can be compared. `capture` is paused meanwhile. The one ref swap
        publishes tables and texts together.
        """
        refs = self.refs()
        h, branch, tip = self.resolve(target, refs), refs.head, self.resolve("HEAD", refs)
        goal, current = self.read_commit(h), self.read_commit(tip)
        names = migrations or []
        if goal.memory_snapshot and goal.schema_version is None:
            raise InvalidInput("target has a snapshot without schema version")
        if goal.schema_version not in (None, "0.0.0", *names):
            raise NotFound(f"schema version {goal.schema_version}")
        start = 0 if goal.schema_version in (None, "0.0.0") else names.index(goal.schema_version) + 1
        undo = list(reversed(names[start:])) if goal.memory_snapshot or goal.schema_version else []
        for n in undo:
            if n not in (down or {}):
                raise MissingReverseMigration(n)
            if n in irreversible and not accept_data_loss:
                raise MissingReverseMigration(f"{n} is irreversible")
        wanted = {n: self.get(x) for n, x in goal.prompts.items()}
        if folder is not None:
            check_prompts(folder, wanted)
        if undo or accept_data_loss:
            self.gate.check(h, uid, token, accept_data_loss, int(now.timestamp()), dry_run)
        if dry_run:
            return h
        with self.writing(), capture.paused() if capture is not None else nullcontext():
            present = None
            if current.memory_snapshot and (keep_present or (undo and not goal.memory_snapshot)):
                present = self.reverse_migrate(current.memory_snapshot, [(n, down[n]) for n in undo], goal.schema_version or "0.0.0")
            if folder is not None:
                write_prompts(folder, wanted)
            c = replace(goal, parent=tip, author="rollback", message=f"rollback to {h}", committed_at=now.isoformat(), peer_uid=uid, memory_snapshot=goal.memory_snapshot or (present if undo else None))
            if keep_present and present:
                (self.root / f"refs/present/{c.hash}").write_text(present)
            return self._publish(branch, c)

    def present_before(self, rollback: str) -> str:
        """The manifest of the tables as they were before a rollback, in the target's layout (see keep_present)."""
        path = self.root / f"refs/present/{rollback}"
        if not path.exists():
            raise NotFound(rollback)
        return path.read_text()


class Quiesceable(Protocol):
    """A capture that can be paused: no change that is written meanwhile is captured."""

    def paused(self) -> AbstractContextManager[None]: ...


def assemble(branch: str, message: str, given: dict[str, object], parent: str | None, snapshot: tuple[str, str] | None, tools: dict[str, str], uid: int | None) -> dict[str, object]:
    """Arguments of Store.commit() from what a caller gave, what was captured and who asked; the author is `unknown` unless given."""
    known = {k: given[k] for k in ("author", "prompts", "model", "code_sha") if given.get(k) is not None}
    return {"branch": branch, "message": message, "author": "unknown", "tools": tools, "peer_uid": uid, "memory_snapshot": snapshot and snapshot[0], "schema_version": snapshot and snapshot[1]} | known


class MemoryBackend:
    """Small tables of JSON rows in the driver, with the operations of a versioned backend; for tests and tools without tables."""

    def __init__(self, store: Store, schema_version: str = "0.0.0") -> None:
        self.store, self.version = store, schema_version
        self.tables: dict[str, list[dict]] = {}
        self.migrations: list[str] = []

    def insert_rows(self, table: str, rows: list[dict]) -> None:
        self.tables.setdefault(table, []).extend(dict(r) for r in rows)

    def rows_of(self, table: str) -> list[dict]:
        return [dict(r) for r in self.tables.get(table, [])]

    def apply_migration(self, name: str) -> None:
        self.migrations.append(name)
        self.version = name

    def migrations_after(self, name: str) -> list[str]:
        """Names applied after `name`, newest first; 0.0.0 stands before all."""
        if name == "0.0.0":
            return self.migrations[::-1]
        if name not in self.migrations:
            raise NotFound(f"migration {name}")
        return self.migrations[self.migrations.index(name) + 1 :][::-1]

    def snapshot(self) -> tuple[str, str]:
        """(manifest, schema version) of all tables as they are."""
        return self.store.put(json.dumps({"tables": self.tables, "schema_version": self.version}, sort_keys=True)), self.version

    def restore(self, snapshot: tuple[str, str]) -> None:
        """Replace all tables, those that the snapshot lacks included; another schema version is refused."""
        held = json.loads(self.store.get(snapshot[0]))
        if held["schema_version"] != self.version:
            raise SchemaMismatch(f"{held['schema_version']} is not {self.version}")
        self.tables = held["tables"]

    def apply_reverse_migrations(self, steps: list[tuple[str, Callable[[str, list[dict]], list[dict]]]]) -> None:
        """Undo migrations, newest first, all or none."""
        tables, left = {t: self.rows_of(t) for t in self.tables}, list(self.migrations)
        for name, step in steps:
            if not left or left[-1] != name:
                raise MissingReverseMigration(f"{name} is not the newest migration")
            left.pop()
            tables = {t: step(t, rows) for t, rows in tables.items()}
        self.tables, self.migrations = tables, left
        self.version = left[-1] if left else "0.0.0"


class Checkpointer:
    """Checkpoints of threads on branches of the store; a thread's branch head is its newest checkpoint."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def put(self, thread: str, checkpoint: tuple[str, bytes], metadata: tuple[str, bytes], now: datetime) -> str:
        from .functions.documents import branch_of_thread, encode_checkpoint

        text = encode_checkpoint(thread, checkpoint, metadata)
        return self.store.commit(branch_of_thread(thread), f"checkpoint of {thread}", now, prompts={"__checkpoints__/checkpoint.json": text})

    def get(self, thread: str) -> tuple[tuple[str, bytes], tuple[str, bytes]] | None:
        from .functions.documents import branch_of_thread, decode_checkpoint

        try:
            c = self.store.read_commit(self.store.resolve(branch_of_thread(thread)))
        except NotFound:
            return None
        return decode_checkpoint(self.store.get(c.prompts["__checkpoints__/checkpoint.json"]))

    def list(self, thread: str) -> list:
        found = self.get(thread)
        return [] if found is None else [found]
