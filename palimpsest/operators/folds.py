"""Folding change events to rows: last writer wins, partial upserts, packing, key ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical_pk
from ..session import cut
from .spread import rank_within


def last_writer_wins(events: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """The last event of each key by `order` if it is no delete, with all columns.

    One aggregation with map-side combine: a hot key costs one row per task. The order is that of sealing, never that of
    files or keys. Null keys form no row.
    """
    rest = [c for c in events.columns if c not in keys]
    last = events.where(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)) == F.lit(False)).groupBy(*keys).agg(F.max_by(F.struct(*rest, deleted.alias("_gone")), F.struct(*order)).alias("e"))
    return last.where("not e._gone").select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])


def partial_upsert(events: DataFrame, key: str, seq: str, deleted: Column, present: dict[str, Column]) -> DataFrame:
    """Rows built from events that carry only some columns: each column has its value of the last event that carried it since the last delete.

    present: per column, whether an event carries it. One aggregation: of each column the last carried value and its place,
    which counts if it comes after the last delete. A key whose last event is a delete has no row; an upsert with the key
    alone makes the row exist.
    """
    aggs = [F.max(F.when(deleted, F.col(seq))).alias("_gone"), F.max(F.when(~deleted, F.col(seq))).alias("_seen")]
    aggs += [F.max(F.when(~deleted & p, F.struct(F.col(seq).alias("at"), F.col(c).alias("v")))).alias(f"_{c}") for c, p in present.items()]
    folded = events.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    since = F.coalesce("_gone", F.lit(-(2**62)).cast("long"))
    return folded.where(F.col("_seen") > since).select(key, *[F.when(F.col(f"_{c}.at") > since, F.col(f"_{c}.v")).alias(c) for c in present])


def running_total(df: DataFrame, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` up to and with each row, in global order of `order` (unique).

    Rows are range-partitioned and sorted; each range sums by itself and starts from the total of the ranges before it
    (one row per range), so no task sees more than its range.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    upto = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value).over(upto))
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    start = totals.select("_range", F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # one row per range
    return local.join(F.broadcast(start), "_range").withColumn(out, (F.col("_local") + F.col("_start")).cast("long")).drop("_range", "_local", "_start")


def pack_by_bytes(df: DataFrame, order: list[str], size: str, target: int) -> DataFrame:
    """Adds `segment_no`: rows in order, cut where the running size passes multiples of `target`.

    This is the documented packing: parallel and deterministic, and no segment exceeds target by more than one row.
    """
    return running_total(df, order, size, "running_bytes").withColumn("segment_no", F.floor((F.col("running_bytes") - F.col(size)) / target).cast("long"))


def pack_greedily(df: DataFrame, order: str, size: str, target: int) -> DataFrame:
    """Adds `segment_no` and `running_bytes`: rows in order of `order` (unique), a segment is sealed by the row with which it reaches `target`.

    Each row points to the first row of the segment that would follow one begun with it: the first whose running size
    before it has grown by the target, found by sorting rows and such sought sizes together, range by range. Segments
    begin at what the first row's pointers reach, by doubling (hierarchy.chain), so no task walks through the rows. The
    last segment may be short. Sizes are not negative; an empty row can begin a segment, as it would in a row-wise pass.
    """
    from .hierarchy import chain

    total = cut(running_total(df, [order], size, "running_bytes"))
    at = total.select(F.col(order).alias("id"), (F.col("running_bytes") - F.col(size)).alias("before"), "running_bytes")
    # the sealing row is the first with running >= before + target; the next segment begins with the row after it
    ends = at.select("id", F.col("running_bytes").alias("v"), F.lit(1).alias("kind")).unionByName(at.select("id", (F.col("before") + target).alias("v"), F.lit(0).alias("kind")))
    n = df.sparkSession.sparkContext.defaultParallelism
    # rows by running size, then by order: among equal sizes the first row is sought
    ranged = cut(ends.repartitionByRange(n, "v").withColumn("_range", F.spark_partition_id()))
    first = F.when(F.col("kind") == 1, F.struct("v", "id"))
    later = W.partitionBy("_range").orderBy(F.desc("v"), F.desc("kind"), F.desc("id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.withColumn("sealing", F.last(first, True).over(later))
    begins = ranged.groupBy("_range").agg(F.min(first).alias("b"))
    after = begins.select("_range", F.first("b", True).over(W.orderBy("_range").rowsBetween(1, W.unboundedFollowing)).alias("after"))  # one row per range
    sealed = local.where("kind = 0").join(F.broadcast(after), "_range").select("id", F.coalesce("sealing", "after").alias("s")).where("s is not null").select("id", F.col("s.id").alias("sealing"))
    numbered = cut(rank_within(total.select(F.lit(0).alias("g"), F.col(order).alias("id")), ["g"], ["id"], "place").drop("g"))
    links = sealed.join(numbered.select(F.col("id").alias("sealing"), (F.col("place") + 1).alias("next")), "sealing").join(numbered.select(F.col("id").alias("parent"), F.col("place").alias("next")), "next").select("id", "parent")
    starts = chain(cut(links), numbered.where("place = 1").select("id"))
    both = total.join(starts.select(F.col("id").alias(order), F.col("distance").alias("_begins")), order, "left")
    # rows take the last beginning up to them, again range by range
    spread = cut(both.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()))
    upto = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    highest = spread.groupBy("_range").agg(F.max("_begins").alias("h"))
    earlier = highest.select("_range", F.max("h").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_from"))  # one row per range
    out = spread.withColumn("_here", F.max("_begins").over(upto)).join(F.broadcast(earlier), "_range")
    return out.withColumn("segment_no", F.coalesce("_here", "_from")).drop("_range", "_begins", "_here", "_from")


def key_ranges(packed: DataFrame, by: list[str], key: Column) -> DataFrame:
    """True least and greatest key, and number of rows, of each segment."""
    return packed.groupBy(*by).agg(F.min(key).alias("pk_lo"), F.max(key).alias("pk_hi"), F.count("*").alias("row_count"))


def manifest_order(entries: DataFrame) -> DataFrame:
    """Entries in order of table, key range and place."""
    return entries.orderBy("table_name", "pk_lo", "pk_hi", "seal_seq")


def adjacent_violations(entries: DataFrame, by: str, order: str) -> DataFrame:
    """Per manifest: entries out of order or repeated, each against the entry before it. (manifest_violations() looks at versions as well.)"""
    w = W.partitionBy(by).orderBy(order)
    here, before = F.struct("table_name", "pk_lo", "pk_hi"), F.lag(F.struct("table_name", "pk_lo", "pk_hi")).over(w)
    seen = entries.withColumn("unsorted", F.coalesce(here < before, F.lit(False))).withColumn("repeated", F.coalesce(here == before, F.lit(False)))
    return seen.groupBy(by).agg(F.count_if("unsorted").alias("n_unsorted"), F.count_if("repeated").alias("n_repeated"), F.count("*").alias("n_entries"))


def manifest_violations(entries: DataFrame, by: str, order: str, version: Column) -> DataFrame:
    """Per manifest: n_unsorted, n_repeated and no_version, all that a manifest is refused for; entries compare by table and true key order."""
    key = lambda c: F.struct(*[k.alias(f"k{i}") for i, k in enumerate(canonical_pk(F.col(c)))])
    here = F.struct("table_name", key("pk_lo").alias("lo"), key("pk_hi").alias("hi"))
    marked = entries.select(by, order, here.alias("here"), F.coalesce(F.trim(version) == "", F.lit(True)).alias("no_version"))
    before = F.lag("here").over(W.partitionBy(by).orderBy(order))
    seen = marked.withColumn("unsorted", F.coalesce(F.col("here") < before, F.lit(False))).withColumn("repeated", F.coalesce(F.col("here") == before, F.lit(False)))
    return seen.groupBy(by).agg(F.count_if("unsorted").alias("n_unsorted"), F.count_if("repeated").alias("n_repeated"), F.bool_or("no_version").alias("no_version"))


def same_shape_runs(envelopes: DataFrame, by: str, order: str, shape: Column) -> DataFrame:
    """Runs of consecutive envelopes of equal shape within a segment: (by, run, shape, first, n)."""
    w = W.partitionBy(by).orderBy(order)
    marked = envelopes.withColumn("shape", shape)
    marked = marked.withColumn("_new", (~F.lag("shape").over(w).eqNullSafe(F.col("shape"))).cast("int"))
    return marked.withColumn("run", F.sum("_new").over(w)).groupBy(by, "run", "shape").agg(F.min(order).alias("first"), F.count("*").alias("n"))


#: Most rows of a replayed batch, and most parameters.
MOST_ROWS, MOST_PARAMETERS = 1_000, 60_000


def replay_batches(envelopes: DataFrame, by: str, order: str, shape: Column, key: Column, width: Column) -> DataFrame:
    """(by, batch, shape, first, n): consecutive envelopes of a segment that one statement can replay.

    A batch ends where the shape changes, a key comes again within it, or one more row would pass MOST_ROWS or
    MOST_PARAMETERS (`width` per row). Where the next batch begins depends on where the last one did, so a segment goes
    through one pass in order; segments are bounded when they are sealed, and only shape, key and width of their rows move.
    """
    rows = envelopes.select(by, F.col(order).cast("long").alias("at"), shape.alias("shape"), key.alias("key"), F.coalesce(width.cast("long"), F.lit(0).cast("long")).alias("width"))
    each = rows.repartition(by).sortWithinPartitions(by, "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, seen, params = None, [], set(), 0
        for b in batches:
            for segment, at, kind, k, w in zip(*(b.column(c).to_pylist() for c in (by, "at", "shape", "key", "width"))):
                if now is None or now[0] != segment or now[2] != kind or k in seen or now[4] >= MOST_ROWS or params + w > MOST_PARAMETERS:
                    out += [tuple(now)] if now else []
                    now = [segment, now[1] + 1 if now and now[0] == segment else 1, kind, at, 0]
                    seen, params = set(), 0
                seen.add(k)
                params += w
                now[4] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], [by, "batch", "shape", "first", "n"])
            out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], [by, "batch", "shape", "first", "n"])

    return each.mapInArrow(walk, f"{by} string, batch long, shape string, first long, n long")


def refuse(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """df, failing the job with `message` on the first row for which `bad` holds."""
    return df.where(F.when(bad, F.raise_error(message)).otherwise(F.lit(True)))


def ordered_scan(df: DataFrame, pk: str, table: str) -> DataFrame:
    """Rows in order of their key; a null key is refused with the names of table and column."""
    return refuse(df, F.col(pk).isNull(), F.lit(f"null primary key in {table}.{pk}")).orderBy(pk)


def finite(df: DataFrame, table: str) -> DataFrame:
    """df, refusing NaN and infinities with the names of table and column."""
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            df = refuse(df, non_finite(F.col(c)), F.lit(f"non-finite value in {table}.{c}"))
    return df


def non_finite(c: Column) -> Column:
    return F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
