"""Problem 1: the present state of tables from a feed of inserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import with_body, with_key
from ..functions.names import Tracked, resolve
from ..session import cut

OPS = ("insert", "update", "delete")


def read_changes(log: DataFrame, tracked: list[Tracked], image: bool = False) -> DataFrame:
    """Valid changes as (table_name, pk, id, live[, image]).

    Void and left out: null id, unknown op or table, JSON that does not parse (null, empty, cut short), null, absent or
    unreadable keys. Extra columns of the log are not read.
    """
    op = F.lower(F.regexp_replace(F.col("op"), r"^\s+|\s+$", ""))
    rows = log.select(
        resolve(F.col("table_name"), tracked).alias("table_name"), F.col("id").cast("long").alias("id"), op.alias("op"), F.col("row").alias("text")
    ).where(F.col("op").isin(*OPS) & F.col("table_name").isNotNull() & F.col("id").isNotNull())
    rows = with_key(with_body(rows), tracked)
    rows = rows.select("table_name", "pk", "id", (F.col("op") != "delete").alias("live"), *([F.to_json("v").alias("image")] if image else []))
    return rows.where("pk is not null")


def resolve_newest_first(changes: DataFrame, base: DataFrame | None = None, shares: tuple[float, ...] = (0.5, 0.75, 0.875)) -> DataFrame:
    """State of each key after all changes: (table_name, pk, id, live[, image]).

    Batches of ids are taken from the newest backwards, at the quantiles `shares` of id. A batch is reduced to the newest
    change of each key (combined map-side, so a hot key costs one row per task), keys already resolved by newer batches are
    anti-joined away, and the rest is recorded as image (live) or tombstone. Rows of `base` (same columns) whose key no
    change touched are appended last. Repeated changes with one id count once; among unlike changes with one id the one
    that sorts last holds. Order in files does not matter. Empty input gives an empty result.
    """
    names = changes.columns
    changes = cut(changes)
    bounds = changes.agg(F.percentile_approx("id", list(shares), 10000).alias("q")).first().q or []
    edges = [None, *sorted(set(bounds), reverse=True), None]
    done: DataFrame | None = None
    for k, (upper, lower) in enumerate(zip(edges, edges[1:])):
        batch = changes
        if upper is not None:
            batch = batch.where(F.col("id") <= upper)
        if lower is not None:
            batch = batch.where(F.col("id") > lower)
        newest = batch.groupBy("table_name", "pk").agg(F.max(F.struct(*names[2:])).alias("c"))
        if done is not None:
            newest = newest.join(done.select("table_name", "pk"), ["table_name", "pk"], "left_anti")
        newest = newest.select("table_name", "pk", "c.*")
        if k < len(edges) - 2:
            newest = cut(newest)
        done = newest if done is None else done.unionByName(newest)
    if base is not None:
        done = done.unionByName(base.select(*names).join(done.select("table_name", "pk"), ["table_name", "pk"], "left_anti"))
    return done


def live_rows(changes: DataFrame, base: DataFrame | None = None) -> DataFrame:
    return resolve_newest_first(changes, base).where("live").drop("live")
