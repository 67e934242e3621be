"""Restoring tables from the segments of a manifest; forward records; batches of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import reference, with_body, with_key
from ..functions.names import Tracked, resolve
from ..functions.once import once
from .folds import refuse

OPS = ("insert", "update", "delete")


def envelopes(segments: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """(segment, table_name, at, op, pk, empty, v) of every element of every stored segment; of repeated segments the fullest holds. empty: a row without any field."""
    one = segments.select(reference(F.col("segment")).alias("segment"), resolve(F.col("table_name"), tracked).alias("table_name"), "rows").where("segment is not null and rows is not null")
    one = one.groupBy("segment").agg(F.max_by(F.struct("table_name", "rows"), F.size("rows")).alias("s")).select("segment", "s.table_name", F.posexplode("s.rows").alias("at", "text"))
    rows = with_body(one)
    op = F.coalesce(F.lower(F.trim(F.try_variant_get("v0", "$.op", "string"))), F.lit("insert"))
    keyed = with_key(once(rows, op=F.when(F.col("v").isNotNull() & ~F.is_variant_null("v"), op)), tracked)
    return keyed.select("segment", "table_name", "at", "op", "pk", F.coalesce(F.when(F.col("pk").isNull(), F.to_json("v") == "{}"), F.lit(False)).alias("empty"), "v")


def live_places(entries: DataFrame, events: DataFrame, strict: bool = True) -> DataFrame:
    """(manifest, table_name, pk, segment, at): where the row of each key live under each manifest is stored.

    entries: (manifest, pos, segment); events: envelopes(). The envelopes of a manifest's segments are folded in order
    (entry, element) by place alone. Per key the last envelope holds, a delete leaves nothing, an insert after it revives
    the key. An upsert of an empty row is skipped. With `strict` an envelope of unknown op or without key, an empty delete
    among them, fails the job.
    """
    events = events.where(~(F.col("empty") & F.coalesce(F.col("op").isin("insert", "update"), F.lit(False))))
    if strict:
        events = refuse(events, ~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), F.concat(F.lit("unknown op in segment "), F.col("segment")))
        events = refuse(events, F.col("pk").isNull(), F.concat(F.lit("no key in segment "), F.col("segment")))
    else:
        events = events.where(F.col("op").isin(*OPS) & F.col("pk").isNotNull())
    # of several envelopes of a segment for one key the last decides, whatever the manifest: they fold before they multiply
    one = events.groupBy("segment", "table_name", "pk").agg(F.max(F.struct("at", (F.col("op") == "delete").alias("gone"))).alias("e")).select("segment", "table_name", "pk", "e.*")
    rows = entries.select("manifest", "pos", "segment").join(one, "segment")
    last = rows.groupBy("manifest", "table_name", "pk").agg(F.max(F.struct("pos", "at", "gone", "segment")).alias("e"))
    return last.where("not e.gone").select("manifest", "table_name", "pk", "e.segment", "e.at")


def live_rows(entries: DataFrame, events: DataFrame, strict: bool = True) -> DataFrame:
    """(manifest, table_name, pk, row) live under each manifest: live_places() with the rows, which are fetched for the places that hold alone."""
    values = events.select("segment", "at", F.to_json("v").alias("row"))
    return live_places(entries, events, strict).join(values, ["segment", "at"]).select("manifest", "table_name", "pk", "row")


def forward_record(commits: DataFrame, tip: DataFrame, target: DataFrame, author: str, at: str) -> DataFrame:
    """The commit that records a rollback: parent is the tip, dimensions are the target's, nothing else is taken over.

    tip, target: one column commit_hash each. Its id covers dimensions and metadata.
    """
    dims = ["code_sha", "model", "memory_snapshot", "schema_version", "prompts", "tools"]
    t = commits.join(target.select("commit_hash"), "commit_hash").select(*dims, F.concat(F.lit("rollback to "), F.col("commit_hash")).alias("message"))
    new = t.crossJoin(tip.select(F.col("commit_hash").alias("parent")))  # one row each
    new = new.withColumn("author", F.lit(author)).withColumn("committed_at", F.lit(at).cast("timestamp"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("parent", "author", "message", "code_sha", "model", "memory_snapshot", "schema_version")]
    return new.withColumn("commit_hash", F.sha2(F.concat_ws("\n", *parts, F.lit(at)), 256))


def classify_changes(log: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """The log with table, op and key read, and `problem`: null, or why a change cannot be applied (the first that holds)."""
    op = F.lower(F.regexp_replace(F.col("op"), r"^\s+|\s+$", ""))
    rows = log.select("id", F.col("table_name").alias("given"), resolve(F.col("table_name"), tracked).alias("table_name"), op.alias("op"), F.col("row").alias("text"))
    rows = with_key(with_body(rows), tracked)
    problem = (
        F.when(F.col("id").isNull(), "no id").when(F.col("table_name").isNull(), "untracked table").when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), "unknown op")
        .when(F.col("v0").isNull(), "unreadable row").when(F.col("pk").isNull(), "no key")
    )
    return once(rows, problem=problem).select("id", "given", "table_name", "op", "pk", "text", "problem")
