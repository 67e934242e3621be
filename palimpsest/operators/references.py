"""Problem 2: references to records that are missing, deleted or arrive later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import reference


def references(df: DataFrame, table: str, name: str, record: Column, target: Column, at: Column) -> DataFrame:
    """References as (ref_table, ref_field, record_key, target, at); blank targets are none, records without a key cannot be named and are left out."""
    return df.select(
        F.lit(table).alias("ref_table"), F.lit(name).alias("ref_field"), reference(record).alias("record_key"), reference(target).alias("target"), at.alias("at")
    ).where("record_key is not null and target is not null")


def parents(df: DataFrame, key: Column, since: Column, until: Column) -> DataFrame:
    """Validity interval of each parent key: from its first time, until it was reclaimed (null: still there)."""
    return df.select(reference(key).alias("key"), since.alias("since"), until.alias("until")).where("key is not null").groupBy("key").agg(F.min("since").alias("since"), F.max("until").alias("until"))


def orphans(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """One row per record and unavailable key: (ref_table, ref_field, record_key, missing_key, kind, period).

    Both streams are hash-partitioned alike by key, sorted and merged linearly (sort-merge join; the parent side has one
    row a key, so a hot target is a split of the reference side under adaptive skew handling, never a product). `missing`:
    no such parent; `deleted`: its interval is closed; `late`: it begins after the record. A record repeated in the
    input counts once, with its earliest time.
    """
    kind = (
        F.when(F.col("key").isNull(), "missing")
        .when(F.col("until").isNotNull(), "deleted")
        .when(F.col("since") > F.col("at"), "late")
    )
    merged = refs.hint("merge").join(parent.hint("merge"), refs.target == parent.key, "left")
    hit = merged.select("ref_table", "ref_field", "record_key", F.col("target").alias("missing_key"), "at", "key", "since", "until").withColumn("kind", kind)
    hit = hit.where("kind is not null").groupBy("ref_table", "ref_field", "record_key", "missing_key").agg(F.min(F.struct("at", "kind")).alias("m"))
    return hit.select("ref_table", "ref_field", "record_key", "missing_key", F.col("m.kind").alias("kind"), F.date_format("m.at", "yyyy-MM").alias("period"))


def commit_references(commits: DataFrame, manifests: DataFrame, segments: DataFrame) -> DataFrame:
    """The three references of the version store against their targets."""
    c, m = F.col, manifests.select("manifest", "taken_at", F.explode("entries").alias("e"))
    none = F.lit(None).cast("timestamp")
    out = orphans(references(commits, "commits", "parent", c("commit_hash"), c("parent"), c("committed_at")), parents(commits, c("commit_hash"), c("committed_at"), none))
    out = out.unionByName(orphans(references(commits, "commits", "memory_snapshot", c("commit_hash"), c("memory_snapshot"), c("committed_at")), parents(manifests, c("manifest"), c("stored_at"), c("reclaimed_at"))))
    return out.unionByName(orphans(references(m, "segment_manifests", "segment", c("manifest"), c("e.segment"), c("taken_at")), parents(segments, c("segment"), c("stored_at"), c("reclaimed_at"))))


def per_period(found: DataFrame) -> DataFrame:
    """Report: references by table, field, kind and month."""
    return found.groupBy("ref_table", "ref_field", "kind", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("missing_key").alias("n_keys"))
