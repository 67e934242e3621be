"""Change capture with Structured Streaming: draining a feed, dead letters, sealing heads to segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.names import Tracked
from ..functions.scalars import canonical_pk
from ..operators.restoring import classify_changes

FEED = "id long, table_name string, op string, row string, captured_at timestamp_ntz"


def read_feed(spark: SparkSession, path: str, schema: str = FEED, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files (or a glob) as a stream; the source's rate limit takes the place of a bounded queue."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class BadChange(ValueError):
    """A strict drain met a change it cannot apply; nothing of its batch was written."""


def drain(feed: DataFrame, tracked: list[Tracked], out: str, strict: bool = False, trigger: dict[str, Any] | None = None):
    """Start draining: valid changes to out/changes, others with their problem to out/dead_letter, one folder per batch.

    A batch replayed after a crash overwrites its own folder, so rows arrive once. With `strict` a batch that holds a bad
    change fails as a whole before anything is written. By default everything there is gets drained, then the query ends.
    """

    def put(batch: DataFrame, n: int) -> None:
        rows = classify_changes(batch, tracked).persist()
        try:
            if strict and (bad := rows.where("problem is not null").select("id", "problem").head(1)):
                raise BadChange(f"change {bad[0].id}: {bad[0].problem}")
            rows.where("problem is null").drop("problem").write.mode("overwrite").parquet(f"{out}/changes/batch={n}")
            rows.where("problem is not null").write.mode("overwrite").parquet(f"{out}/dead_letter/batch={n}")
        finally:
            rows.unpersist()

    return feed.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/offsets").trigger(**(trigger or {"availableNow": True})).start()


def drained(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{out}/changes"), spark.read.parquet(f"{out}/dead_letter")


SEALED = "table_name string, shard int, seal_seq int, pk_lo string, pk_hi string, event_count long, n_bytes long"
_BOUND = "struct<t:boolean,n:double,k:string>"
_ADDED = f"table_name string, shard int, id long, n_bytes long, key {_BOUND}"
_HEAD = "seal_seq int, event_count long, n_bytes long, lo_t boolean, lo_n double, lo_k string, hi_t boolean, hi_n double, hi_k string"


def key_order(pk: Column) -> Column:
    """A key as a struct that sorts as heads and manifests do: numbers before text, numbers by value."""
    is_text, number, _ = canonical_pk(pk)
    return F.struct(is_text.alias("t"), F.coalesce(number, F.lit(0.0)).alias("n"), pk.alias("k"))


def shard_of(pk: Column, shards: int) -> Column:
    """The head of a key: the first eight hex digits of its MD5, modulo the number of heads."""
    return F.pmod(F.conv(F.substring(F.md5(pk.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def sealer(target: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """State function of one head: events gather until `target` bytes are reached, then the head is sealed and a new one begins.

    The events of a batch go in order of id. Where the running size passes the target is found by binary search over
    running sums, so the cost is that of sums and bounds over arrays plus one step per sealed segment.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, n, size, *held = state.get if state.exists else (0, 0, 0, *[None] * 6)
        lo, hi = (tuple(held[:3]), tuple(held[3:])) if held[2] is not None else (None, None)
        rows = pd.concat(list(batches)).sort_values(["id", "n_bytes"], kind="stable")
        sizes = rows["n_bytes"].to_numpy()
        total = np.concatenate(([0], np.cumsum(sizes)))
        keys = [(k["t"], k["n"], k["k"]) for k in rows["key"]]
        out, at = [], 0
        while at < len(keys):
            end = min(int(np.searchsorted(total, total[at] + target - size, "left")), len(keys))
            end = max(end, at + 1)
            least, most = min(keys[at:end]), max(keys[at:end])
            lo, hi = (least, most) if lo is None else (min(lo, least), max(hi, most))
            n, size, at = n + end - at, size + int(total[end] - total[at]), end
            if size >= target:
                out.append((*key, seq, lo[2], hi[2], n, size))
                seq, n, size, lo, hi = seq + 1, 0, 0, None, None
        none = (None, None, None)
        state.update((seq, n, size, *(lo or none), *(hi or none)))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEALED.split(", ")])

    return step


def seal_heads(changes: DataFrame, target: int, shards: int = 16) -> DataFrame:
    """Stream of sealed segment descriptors from a stream of valid changes (id, table_name, pk, text).

    Each table has `shards` heads by key, so that a hot table is spread over tasks and a key's changes stay in one head;
    the state of a head is counts and bounds, not its rows. Least and greatest keys are by value (key_order). A batch
    bounds what a head gets at once (see read_feed); more heads spread a hotter table.
    """
    rows = changes.select("table_name", shard_of(F.col("pk"), shards).alias("shard"), "id", F.octet_length("text").cast("long").alias("n_bytes"), key_order(F.col("pk")).alias("key"))
    return rows.groupBy("table_name", "shard").applyInPandasWithState(sealer(target), SEALED, _HEAD, "append", GroupStateTimeout.NoTimeout)


REFS = "table_name string, seal_seq long, pk_lo string, pk_hi string, event_count long"


class SegmentSink:
    """foreachBatch sink that seals each batch as one segment per table and lists it in a manifest, once per batch number."""

    def __init__(self, out: str, baseline: DataFrame | list[dict] | None = None) -> None:
        self.out, self.baseline = out, baseline

    def __call__(self, batch: DataFrame, n: int) -> None:
        path = f"{self.out}/segments/seal_seq={n}"
        batch.write.mode("overwrite").partitionBy("table_name").parquet(path)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """REFS: the baseline's and one per table and sealed batch, with least and greatest key by value, seal numbers going on from the baseline's."""
        rows = spark.read.parquet(f"{self.out}/segments")
        key = key_order(F.col("pk").cast("string"))
        refs = rows.groupBy("table_name", "seal_seq").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("event_count"))
        refs = refs.select("table_name", F.col("seal_seq").cast("long").alias("seal_seq"), F.col("lo.k").alias("pk_lo"), F.col("hi.k").alias("pk_hi"), "event_count")
        base = self.baseline
        if not base:
            return refs
        base = base if isinstance(base, DataFrame) else spark.createDataFrame([tuple(r[c.split()[0]] for c in REFS.split(", ")) for r in base], REFS)
        first = F.broadcast(base.agg((F.max("seal_seq") + 1).alias("first")))  # one row
        return base.unionByName(refs.crossJoin(first).withColumn("seal_seq", F.col("seal_seq") + F.coalesce("first", F.lit(0).cast("long"))).drop("first"))


class Capture:
    """A running capture that can be paused: `start` begins the stream from a folder of offsets."""

    def __init__(self, start: Callable[[str], StreamingQuery], offsets: str) -> None:
        self.start, self.offsets, self.generation = start, offsets, 0
        self.query = start(self._folder())

    def _folder(self) -> str:
        return f"{self.offsets}/{self.generation}"

    @contextmanager
    def paused(self) -> Iterator[None]:
        """Stop after the batch at work; go on afterwards with new offsets, so that what came meanwhile is not captured.

        `start` reads from its folder's offsets, or from the present end of the feed where there are none.
        """
        self.query.stop()
        self.query.awaitTermination()
        try:
            yield
        finally:
            self.generation += 1
            self.query = self.start(self._folder())


class Escalation(StreamingQueryListener):
    """Tells of a stream's failures: a warning at first, an error from `limit` failed batches in a row on, then again at every `limit`-th."""

    def __init__(self, tell: Callable[[str, str], None], limit: int = 50) -> None:
        self.tell, self.limit, self.failed = tell, limit, 0

    def failure(self, message: str) -> None:
        self.failed += 1
        if self.failed == 1:
            self.tell("warning", message)
        elif self.failed % self.limit == 0:
            self.tell("error", f"{self.failed} failures in a row: {message}")

    def onQueryStarted(self, event: object) -> None:
        return None

    def onQueryProgress(self, event: object) -> None:
        self.failed = 0

    def onQueryIdle(self, event: object) -> None:
        return None

    def onQueryTerminated(self, event: object) -> None:
        if event.exception is not None:
            self.failure(event.exception)
