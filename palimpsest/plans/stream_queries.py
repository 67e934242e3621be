"""Queries that run a stream over the whole change log and return what it wrote."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import tracked_list
from ..session import scratch, table
from ..streaming import capture
from .reference_queries import PROBLEM, RESOLVED, clean


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return capture.read_feed(spark, f"{d}/agentic_change_lo[g].parquet")


def _drain(spark: SparkSession, d: str) -> str:
    out = scratch(spark, "drain")
    capture.drain(_feed(spark, d), tracked_list(table(spark, d, "tracked_tables")), out).awaitTermination()
    return out


def st_poll(spark: SparkSession, d: str) -> DataFrame:
    good, bad = capture.drained(spark, _drain(spark, d))
    return good.select(F.lit("applied").alias("outcome")).unionByName(bad.select(F.col("problem").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


def st_ack(spark: SparkSession, d: str) -> DataFrame:
    """A second drain with the same offsets adds nothing."""
    out = _drain(spark, d)
    capture.drain(_feed(spark, d), tracked_list(table(spark, d, "tracked_tables")), out).awaitTermination()
    good, _ = capture.drained(spark, out)
    return good.groupBy("table_name", "op").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def st_head_state(spark: SparkSession, d: str) -> DataFrame:
    changes = spark.readStream.schema("id long, given string, table_name string, op string, pk string, text string").option("recursiveFileLookup", True).parquet(f"{_drain(spark, d)}/changes")
    out = scratch(spark, "heads")
    sealed = capture.seal_heads(changes, 64 * 1024)
    sealed.writeStream.format("parquet").option("path", f"{out}/sealed").option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(capture.SEALED).parquet(f"{out}/sealed")


def st_take_snapshot(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "snapshot")
    sink = capture.SegmentSink(out)
    changes = spark.readStream.schema("id long, given string, table_name string, op string, pk string, text string").option("recursiveFileLookup", True).parquet(f"{_drain(spark, d)}/changes")
    changes.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()
    lo, hi = capture.key_order(F.col("pk_lo")), capture.key_order(F.col("pk_hi"))
    refs = sink.manifest(spark).groupBy("table_name").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.sum("event_count").alias("event_count"))
    return refs.select("table_name", F.col("lo.k").alias("pk_lo"), F.col("hi.k").alias("pk_hi"), "event_count")


READ_LOG = f"""(SELECT *, CASE WHEN json_exists(j, '$.row') AND json_exists(j, '$.op') THEN j->'$.row' ELSE j END AS body FROM
  (SELECT id, {RESOLVED} AS t, {clean('op')} AS o, CASE WHEN json_valid(row) THEN row::JSON END AS j FROM agentic_change_log))"""

QUERIES = {"st_poll": st_poll, "st_ack": st_ack, "st_head_state": st_head_state, "st_take_snapshot": st_take_snapshot}
_KEY = "CASE t WHEN 'agent.facts' THEN body->>'$.fact_id' WHEN 'public.checkpoints' THEN body->>'$.checkpoint_id' ELSE body->>'$.id' END"
_PLAIN = f"CASE WHEN regexp_full_match({_KEY}, '-?[0-9]+\\.0+') THEN regexp_replace({_KEY}, '\\.0+$', '') ELSE {_KEY} END"
_ORDER = "{'t': try_cast(pk AS DOUBLE) IS NULL, 'n': coalesce(try_cast(pk AS DOUBLE), 0), 'k': pk}"
_VALID = f"(SELECT id, t AS table_name, row, {_PLAIN} AS pk FROM {READ_LOG.replace('SELECT id,', 'SELECT id, row,')} WHERE ({PROBLEM}) IS NULL)"
#: Greedy sealing: from each head's first event on, the next segment begins after the event that reaches the target.
_SEALED = f"""WITH RECURSIVE v AS (SELECT table_name, ('0x' || substr(md5(pk), 1, 8))::BIGINT % 16 AS shard, {_ORDER} AS k, strlen(row) AS n, row_number() OVER (PARTITION BY table_name, ('0x' || substr(md5(pk), 1, 8))::BIGINT % 16 ORDER BY id, strlen(row)) AS i FROM {_VALID}),
  r AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY table_name, shard ORDER BY i) AS s FROM v),
  g AS (SELECT table_name, shard, 0 AS seal_seq, 0::BIGINT AS lo, min(i) FILTER (s >= 65536) AS hi, min(s) FILTER (s >= 65536) AS upto FROM r GROUP BY 1, 2
    UNION ALL SELECT g.table_name, g.shard, g.seal_seq + 1, g.hi, x.hi, x.upto FROM g, LATERAL (SELECT min(i) AS hi, min(s) AS upto FROM r WHERE r.table_name = g.table_name AND r.shard = g.shard AND r.s >= g.upto + 65536) x WHERE g.hi IS NOT NULL)
  SELECT g.table_name, g.shard::INT AS shard, seal_seq, min(k).k AS pk_lo, max(k).k AS pk_hi, count(*) AS event_count, sum(n)::BIGINT AS n_bytes FROM g JOIN r ON r.table_name = g.table_name AND r.shard = g.shard AND r.i > g.lo AND r.i <= g.hi WHERE g.hi IS NOT NULL GROUP BY 1, 2, 3"""
SQL = {
    "st_take_snapshot": f"SELECT table_name, min({_ORDER}).k AS pk_lo, max({_ORDER}).k AS pk_hi, count(*) AS event_count FROM {_VALID} GROUP BY 1",
    "st_head_state": _SEALED,
    "st_poll": f"SELECT coalesce({PROBLEM}, 'applied') AS outcome, count(*) AS n FROM {READ_LOG} GROUP BY 1",
    "st_ack": f"SELECT t AS table_name, o AS op, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM {READ_LOG} WHERE ({PROBLEM}) IS NULL GROUP BY 1, 2",
}
