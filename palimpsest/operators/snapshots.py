"""Problem 4: what changed between full snapshots, by a bucketed index of key to row hash that each snapshot probes and replaces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.canonical import envelope, object_reader, plain, value_hash
from ..functions.keys import reference
from ..functions.names import Tracked, resolve, resolver
from ..functions.once import once
from ..session import cut
from .spread import rank_within

_ITEM = pa.struct([("pk", pa.string()), ("gone", pa.bool_()), ("h", pa.int64()), ("at", pa.int32())])


def segment_index(segments: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """(segment, n_rows, items): each stored segment once, with key, hash and place of its rows.

    Of repeated rows the one with most elements holds (content is the same, some are cut). Items without a readable key
    are counted but have no key; of several for one key the last is kept, which decides in any snapshot. The hash is over the row by value, without the key field.
    """
    pk = {t.name: t.pk for t in tracked}
    known = resolver(tracked)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = object_reader()
        for b in batches:
            pks, gone, hashes, ats, ends = [], [], [], [], [0]
            for name, rows in zip(b.column("table_name").to_pylist(), b.column("rows").to_pylist()):
                key = pk.get(known.get((name or "").replace('"', "").strip().lower(), ""))
                items: dict[str, tuple] = {}
                for at, text in enumerate(rows if key is not None else ()):
                    x = read(text)
                    if x is None:
                        continue
                    op, row = envelope(x)
                    k = plain(row.pop(key, None))
                    if k is not None and op in ("insert", "update", "delete"):
                        items[k] = (op == "delete", value_hash(row), at)
                pks += items
                for g, h, at in items.values():
                    gone.append(g)
                    hashes.append(h)
                    ats.append(at)
                ends.append(len(pks))
            flat = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((pks, gone, hashes, ats), _ITEM)], fields=list(_ITEM))
            yield pa.RecordBatch.from_arrays([b.column("segment"), b.column("n_rows"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["segment", "n_rows", "items"])

    stored = segments.select(reference(F.col("segment")).alias("segment"), "table_name", "rows").where("segment is not null and rows is not null")
    parsed = stored.withColumn("n_rows", F.size("rows").cast("long")).mapInArrow(index, "segment string, n_rows long, items array<struct<pk:string,gone:boolean,h:long,at:int>>")
    return parsed.groupBy("segment").agg(F.max(F.struct("n_rows", "items")).alias("m")).select("segment", "m.*")


def snapshot_tables(manifests: DataFrame, tracked: list[Tracked]) -> tuple[DataFrame, DataFrame]:
    """(snapshots, entries) of each manifest, which counts once however often it was stored.

    snapshots: (manifest, workspace, schema_version, taken_at); entries: (manifest, workspace, table_name, pos, segment,
    row_count), pos counting the entries of a table from 0.
    Manifests without hash, workspace or time cannot be placed and are left out.
    """
    version = F.regexp_replace(F.lower(F.trim(F.coalesce("schema_version", F.lit("")))), "^v", "")
    one = (
        manifests.select(reference(F.col("manifest")).alias("manifest"), "workspace", version.alias("schema_version"), "taken_at", "stored_at", "entries")
        .where("manifest is not null and workspace is not null and taken_at is not null")
        .groupBy("manifest")
        .agg(F.min_by(F.struct("workspace", "schema_version", "taken_at", "entries"), F.coalesce("stored_at", "taken_at")).alias("m"))
        .select("manifest", "m.*")
    )
    one = cut(one)
    named = F.transform("entries", lambda e: F.struct(resolve(e.table_name, tracked).alias("table_name"), reference(e.segment).alias("segment"), e.row_count.alias("row_count")))
    each = once(one, e=named).select("manifest", "workspace", "e", F.explode(_names(tracked)).alias("table_name"))
    entries = each.select("manifest", "workspace", "table_name", F.posexplode(F.filter("e", lambda e: e.table_name == F.col("table_name"))).alias("pos", "x"))
    return one.drop("entries"), entries.select("manifest", "workspace", "table_name", "pos", "x.segment", "x.row_count")


def _names(tracked: list[Tracked]) -> Column:
    return F.array(*[F.lit(t.name) for t in tracked]) if tracked else F.array().cast("array<string>")


def complete_snapshots(snapshots: DataFrame, entries: DataFrame, held_sizes: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """(workspace, table_name, seq, manifest, same, before, more): complete snapshots of each table in order of time.

    Complete: each entry's segment is there with exactly row_count rows; a snapshot without entries of a table is a
    complete empty one. `same`: the version is that of the snapshot before (null for the first); `more`: one follows.
    """
    sizes = held_sizes
    ok = entries.join(sizes, "segment", "left").groupBy("manifest", "table_name").agg(F.min(F.coalesce(F.col("n_rows") == F.col("row_count"), F.lit(False))).alias("ok"))
    each = snapshots.withColumn("table_name", F.explode(_names(tracked))).join(ok, ["manifest", "table_name"], "left").where(F.coalesce("ok", F.lit(True)))
    group = ["workspace", "table_name"]
    ranked = cut(rank_within(each.select(*group, "manifest", "taken_at", "schema_version"), group, ["taken_at", "manifest"], "seq"))
    # neighbours by equality of (group, place): no task sees all snapshots of a workspace
    before = ranked.select(*group, (F.col("seq") + 1).alias("seq"), F.col("manifest").alias("before"), F.col("schema_version").alias("v0"))
    after = ranked.select(*group, (F.col("seq") - 1).alias("seq"), F.lit(True).alias("more"))
    both = ranked.join(before, [*group, "seq"], "left").join(after, [*group, "seq"], "left")
    return both.select(*group, "seq", "manifest", (F.col("v0") == F.col("schema_version")).alias("same"), "before", F.coalesce("more", F.lit(False)).alias("more"))


def segment_sizes(segments: DataFrame) -> DataFrame:
    """(segment, n_rows): number of elements of each segment that is there, without parsing any."""
    held = segments.select(reference(F.col("segment")).alias("segment"), F.size("rows").cast("long").alias("n_rows"))
    return held.where("segment is not null and n_rows >= 0").groupBy("segment").agg(F.max("n_rows").alias("n_rows"))


def segment_runs(seqs: DataFrame, entries: DataFrame) -> DataFrame:
    """(workspace, table_name, segment, pos, a, b): from which to which complete snapshot a table has a segment at a place, without a break.

    b is null where the last snapshot has it. What successive snapshots share is one run and costs nothing after its first.
    """
    placed = entries.drop("row_count", "workspace").join(seqs.select("workspace", "manifest", "table_name", "seq", "more"), ["manifest", "table_name"]).drop("manifest")
    by = ("workspace", "table_name", "segment", "pos")
    island = F.col("seq") - F.row_number().over(W.partitionBy(*by).orderBy("seq"))
    runs = placed.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("seq").alias("a"), F.max("seq").alias("last"), F.bool_and("more").alias("_more"))
    return runs.select(*by, "a", F.when(F.col("_more"), F.col("last")).alias("b"))


INDEX = "workspace string, table_name string, pk string, segment string, pos int, at int, gone boolean, h long"
_PROBED = "workspace string, table_name string, pk string, seq long, change string, old_at struct<pos:int,at:int>, new_at struct<pos:int,at:int>"


class _Bucket:
    """The index of one bucket of keys of one table: key to the envelopes that the last snapshot has for it, with their row hashes.

    An envelope is (pos, at, gone, h, b); the last by (pos, at) decides, b is the last snapshot that has it (None: all).
    """

    def __init__(self) -> None:
        self.index: dict[str, list[tuple]] = {}
        self.ends: dict[int, list[str]] = {}

    def swap(self, seq: int, fresh: Iterable[tuple[str, tuple]]) -> Iterator[tuple]:
        """Changes that snapshot `seq` brings to the keys whose segments come or go; its envelopes take the place of those before."""
        index, ends = self.index, self.ends
        probes: dict[str, list[tuple]] = {key: [] for key in ends.pop(seq, ())}
        for key, e in fresh:
            probes.setdefault(key, []).append(e)
            if e[4] is not None:
                ends.setdefault(e[4] + 1, []).append(key)
        for key, came in probes.items():
            held = index.get(key, ())
            alive = [e for e in held if e[4] is None or e[4] >= seq]
            alive = alive + came if alive else came
            old = held[0] if len(held) == 1 else max(held, default=None)
            new = alive[0] if len(alive) == 1 else max(alive, default=None)
            if alive:
                index[key] = alive
            elif held:
                del index[key]
            was, here = old is not None and not old[2], new is not None and not new[2]
            if was and here:
                if old[3] != new[3]:
                    yield key, seq, "changed", old, new
            elif here:
                yield key, seq, "added", None, new
            elif was:
                yield key, seq, "removed", old, None

    def forward(self, upto: int | None) -> Iterator[tuple]:
        """swap() for each snapshot before `upto` (None: all) at which segments go and none come."""
        while due := [s for s in self.ends if upto is None or s < upto]:
            yield from self.swap(min(due), ())


def _places(entries: list[tuple | None]) -> pa.Array:
    values = [pa.array([0 if e is None else e[k] for e in entries], pa.int32()) for k in (0, 1)]
    return pa.StructArray.from_arrays(values, ["pos", "at"], mask=pa.array([e is None for e in entries], pa.bool_()))


def probe_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (workspace, table_name, pk, a, b, pos, at, gone, h), sorted by table and a, to changes; memory holds the index of one bucket.

    Rows of one table and snapshot are probed together, even where they come in several batches.
    """
    table, bucket, seq = None, _Bucket(), 0
    fresh: list[Iterable[tuple[str, tuple]]] = []
    out: list[tuple] = []  # (workspace, table_name), changes of a table after its first snapshot

    def settle(upto: int | None) -> None:
        changes = [*bucket.swap(seq, chain.from_iterable(fresh)), *bucket.forward(upto)]
        fresh.clear()
        if changes := [c for c in changes if c[1] > 1]:
            out.append((table, changes))

    def batch() -> pa.RecordBatch:
        rows = [c for _, changes in out for c in changes]
        key, at, change, old, new = zip(*rows) if rows else [()] * 5
        named = [pa.array([t[k] for t, changes in out for _ in changes], pa.string()) for k in (0, 1)]
        out.clear()
        return pa.RecordBatch.from_arrays([*named, pa.array(key, pa.string()), pa.array(at, pa.int64()), pa.array(change, pa.string()), _places(old), _places(new)], ["workspace", "table_name", "pk", "seq", "change", "old_at", "new_at"])

    for b in batches:
        if not b.num_rows:
            continue
        codes = [b.column(c).dictionary_encode().indices.to_numpy() for c in ("workspace", "table_name")] + [b.column("a").to_numpy()]
        starts = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in codes], axis=0))))
        pks, entries = b.column("pk").to_pylist(), list(zip(*(b.column(c).to_pylist() for c in ("pos", "at", "gone", "h", "b"))))
        for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
            here, a = tuple(b.column(c)[int(lo)].as_py() for c in ("workspace", "table_name")), int(codes[2][lo])
            if here != table:
                if table:
                    settle(None)
                table, bucket, seq = here, _Bucket(), a
            elif a != seq:
                settle(a)
                seq = a
            fresh.append(zip(pks[lo:hi], entries[lo:hi]))
        if len(out) > 1_000:
            yield batch()
    if table:
        settle(None)
    yield batch()


def indexed_runs(runs: DataFrame, segments: DataFrame, tracked: list[Tracked], index: DataFrame | None = None) -> DataFrame:
    """Runs with the envelopes of their segments: INDEX and (a, b).

    Segments are read once each, however many snapshots share them. What a stored `index` (the first snapshots', from
    last_index()) has is taken from there, and segments that no other run has are not parsed.
    """
    runs = runs if index is None else cut(runs)
    rest = runs
    known: DataFrame | None = None
    if index is not None:
        tables = index.select("workspace", "table_name").distinct()
        known = index.join(runs.where("a = 1"), ["workspace", "table_name", "segment", "pos"])
        rest = runs.where("a > 1").unionByName(runs.where("a = 1").join(tables, ["workspace", "table_name"], "left_anti"))
        key = reference(F.col("segment"))
        segments = segments.withColumn("_s", key).join(rest.select(F.col("segment").alias("_s")).distinct(), "_s", "left_semi").drop("_s")
    parsed = rest.join(segment_index(segments, tracked).select("segment", "items"), "segment").select("workspace", "table_name", "segment", "pos", "a", "b", F.inline("items"))
    return parsed if known is None else parsed.unionByName(known)


def snapshot_changes(seqs: DataFrame, rows: DataFrame) -> DataFrame:
    """(workspace, table_name, pk, manifest, manifest_before, change, old_at, new_at): keys added, removed or changed since the complete snapshot before.

    rows: indexed_runs(). They are bucketed by key, sorted by snapshot within a bucket, and run through its index: each
    snapshot's new rows probe the key-to-hash index of the one before and then take its place (swap). Segments that both
    share are neither sent nor probed. Rows are compared by 64-bit hashes without an exact check; values are fetched later
    by place, for changes alone. Between snapshots of unlike version nothing is reported. A bucket is a part of one
    shuffle partition, so a task's memory is bounded by the partition size, whatever the size of a workspace or table.
    """
    key = ("workspace", "table_name", "pk")
    sent = rows.select(*key, "a", "b", "pos", "at", "gone", "h").repartition(*key).sortWithinPartitions("workspace", "table_name", "a")
    named = seqs.where("same").select("workspace", "table_name", "seq", "manifest", F.col("before").alias("manifest_before"))
    return sent.mapInArrow(probe_index, _PROBED).join(named, ["workspace", "table_name", "seq"]).select(*key, "manifest", "manifest_before", "change", "old_at", "new_at")


def diff_snapshots(manifests: DataFrame, segments: DataFrame, tracked: list[Tracked], index: DataFrame | None = None) -> DataFrame:
    """snapshot_changes() over stored manifests and segments.

    With `index`, the last_index() of the earliest complete snapshot of each table given, only later snapshots are read:
    a new snapshot costs the index and its new segments.
    """
    snapshots, entries = snapshot_tables(manifests, tracked)
    seqs = cut(complete_snapshots(snapshots, entries, segment_sizes(segments), tracked))
    return snapshot_changes(seqs, indexed_runs(segment_runs(seqs, entries), segments, tracked, index))


def last_index(manifests: DataFrame, segments: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """INDEX of the last complete snapshot of each table, to be stored until the next snapshot comes."""
    snapshots, entries = snapshot_tables(manifests, tracked)
    seqs = cut(complete_snapshots(snapshots, entries, segment_sizes(segments), tracked)).where("not more")
    placed = entries.join(seqs.select("manifest", "table_name"), ["manifest", "table_name"]).select("workspace", "table_name", "segment", "pos")
    rows = placed.join(segment_index(segments, tracked).select("segment", "items"), "segment").select("*", F.inline("items"))
    return rows.select(*[c.split()[0] for c in INDEX.split(", ")])


def fetch_values(changes: DataFrame, manifests: DataFrame, segments: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """changes with old_row and new_row (elements as stored), read for changed keys only."""
    entries = snapshot_tables(manifests, tracked)[1].select(F.col("manifest").alias("m"), F.col("table_name").alias("t"), "pos", "segment")
    for side, manifest in (("old", "manifest_before"), ("new", "manifest")):
        changes = changes.join(entries, (F.col(manifest) == F.col("m")) & (F.col("table_name") == F.col("t")) & (F.col(f"{side}_at.pos") == F.col("pos")), "left").withColumn(f"{side}_in", F.struct("segment", f"{side}_at.at")).drop("m", "t", "pos", "segment")
    wanted = changes.select(F.explode(F.array("old_in", "new_in")).alias("p")).where("p.segment is not null").select("p.segment", "p.at").distinct()
    held = segments.select(reference(F.col("segment")).alias("segment"), "rows").where("rows is not null").join(wanted.select("segment").distinct(), "segment", "left_semi")
    values = held.select("segment", F.posexplode("rows").alias("at", "value")).join(wanted, ["segment", "at"]).groupBy("segment", "at").agg(F.max("value").alias("value"))
    for side in ("old", "new"):
        v = values.select(F.col("segment").alias("s"), F.col("at").alias("a"), F.col("value").alias(f"{side}_row"))
        changes = changes.join(v, (F.col(f"{side}_in.segment") == v.s) & (F.col(f"{side}_in.at") == v.a), "left").drop("s", "a", f"{side}_in")
    return changes.drop("old_at", "new_at")
