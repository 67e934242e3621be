"""Queries of problems 1, 2, 4, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import tracked_list
from ..operators import changes, hierarchy, layouts, references, snapshots
from ..session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tracked = tracked_list(table(spark, d, "tracked_tables"))
    return changes.live_rows(changes.read_changes(table(spark, d, "agentic_change_log"), tracked)).select("table_name", "pk", "id")


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    tracked = tracked_list(table(spark, d, "tracked_tables"))
    return changes.live_rows(changes.read_changes(table(spark, d, "agentic_change_log"), tracked, image=True)).select("table_name", "pk", "id", "image")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return references.commit_references(table(spark, d, "commits"), table(spark, d, "segment_manifests"), table(spark, d, "segments"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.per_period(p2_found(spark, d))


def _diff(spark: SparkSession, d: str) -> DataFrame:
    tracked = tracked_list(table(spark, d, "tracked_tables"))
    return snapshots.diff_snapshots(table(spark, d, "segment_manifests"), table(spark, d, "segments"), tracked)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("workspace", "table_name", "pk", "manifest", "change")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    tracked = tracked_list(table(spark, d, "tracked_tables"))
    return snapshots.fetch_values(_diff(spark, d), table(spark, d, "segment_manifests"), table(spark, d, "segments"), tracked)


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    tracked = tracked_list(table(spark, d, "tracked_tables"))
    return layouts.versioned_rows(table(spark, d, "change_events"), table(spark, d, "segments"), tracked)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return layouts.layout_changes(_versioned(spark, d), table(spark, d, "agentic_migrations"), tracked_list(table(spark, d, "tracked_tables")))


def p5_layouts(spark: SparkSession, d: str) -> DataFrame:
    return layouts.layouts(_versioned(spark, d)).select("table_name", "version", "field", "kind", "n")


def _unified(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _versioned(spark, d).where(F.col("table_name") == name)
        tracked = tracked_list(table(spark, d, "tracked_tables"))
        counts = layouts.counted(rows)
        schema = layouts.union_schema(counts, layouts.layout_changes(rows, table(spark, d, "agentic_migrations"), tracked, counts), name)
        return layouts.unified(layouts.keyed(rows, tracked), schema, name, rest=True)

    return query


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.links_of(table(spark, d, "commits"), F.col("commit_hash"), F.col("parent")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("id").alias("commit_hash"), "root", "depth", "state")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    t = cut(_tree(spark, d))
    return t.join(hierarchy.paths(t), "id", "left").select(F.col("id").alias("commit_hash"), F.array_join("path", "/").alias("path"), "depth", "state")


def p6_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("id").alias("commit_hash"), "root", "pre", "size")


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where("state = 'tree'").select(F.col("id").alias("commit_hash"), "size")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    t = cut(_tree(spark, d))
    return hierarchy.descendants(t, t.where("state = 'tree'")).select(F.col("id").alias("commit_hash"), "descendant", "distance")


QUERIES = {
    "p1_found": p1_found, "p1_state": p1_state, "p2_found": p2_found, "p2_report": p2_report, "p4_found": p4_found, "p4_values": p4_values, "p5_found": p5_found, "p5_layouts": p5_layouts,
    "p5_table_episodes": _unified("public.episodes"), "p5_table_messages": _unified("messages"), "p5_table_checkpoints": _unified("public.checkpoints"), "p5_table_facts": _unified("agent.facts"),
    "p6_found": p6_found, "p6_paths": p6_paths, "p6_ranges": p6_ranges, "p6_descendants": p6_descendants, "p6_sizes": p6_sizes,
}
