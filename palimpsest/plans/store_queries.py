"""Queries that write to a version store in a scratch folder and read it back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import approval
from ..functions import scalars
from ..functions.names import tracked_list
from ..operators import trees
from ..session import cut, scratch, table
from ..shared import SharedPath
from ..sources import prompt_files
from ..store import Checkpointer, Store
from ..streaming import capture
from .reference_queries import COMMITS, PROBLEM, TIP, commits_of, files
from .stream_queries import READ_LOG

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _store(spark: SparkSession) -> Store:
    """A store in the shared folder."""
    s = Store(spark, scratch(spark, "store"), {"customer": "c_custkey", "part": "p_partkey"}, approval.Gate(b"key"))
    s.init()
    return s


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"customer": table(spark, d, "customer"), "part": table(spark, d, "part")}


def snk_fs_store(spark: SparkSession, d: str) -> DataFrame:
    """Distinct contents as a content-addressed table, read back and verified."""
    e = trees.tree_entries(table(spark, d, "commits"), "tools")
    stored = cut(e.groupBy("hash").agg(F.min("text").alias("text")))
    return stored.select("hash", (scalars.content_hash(F.col("text")) == F.col("hash")).alias("intact"), scalars.encoded_len(F.col("text")).alias("size"))


def src_body_cap(spark: SparkSession, d: str) -> DataFrame:
    """Contents within the limit of a fetched body."""
    size = scalars.encoded_len(F.col("text"))
    return trees.tree_entries(table(spark, d, "commits"), "tools").where(size <= 2**20).select("commit_hash", "name", size.alias("size"))


def src_prompt_dir(spark: SparkSession, d: str) -> DataFrame:
    """The files of the last commit on main, written to a folder as an agent's working copy has them, and read back."""
    tip = commits_of(spark, d).where("branch = 'main'").orderBy(F.desc("committed_at"), "commit_hash").limit(1).select("commit_hash")
    wanted = trees.tree_entries(table(spark, d, "commits"), "prompts").join(F.broadcast(tip), "commit_hash").select("name", F.coalesce("text", F.lit("")).alias("text")).collect()  # one commit
    folder = SharedPath(spark, scratch(spark, "prompts"))
    folder.mkdir()
    for r in wanted:
        (folder / r.name).write_text(r.text)
    return prompt_files(spark, str(folder))


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    seg = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    old = c.join(seg.where("c_mktsegment <> 'BUILDING'").select("c_custkey"), "c_custkey", "left_semi")
    new = c.where("c_nationkey <> 3").withColumn("c_name", F.when(F.col("c_nationkey") > 20, F.upper("c_name")).otherwise(F.col("c_name")))
    return old, new


def st_capture(spark: SparkSession, d: str) -> DataFrame:
    return trees.captured(*_states(spark, d), "c_custkey", "customer").select("table_name", "op", "pk")


def st_drain_strict(spark: SparkSession, d: str) -> DataFrame:
    """A strict drain of the log, which holds changes that cannot be applied: it fails and writes nothing."""
    out = scratch(spark, "strict")
    try:
        capture.drain(capture.read_feed(spark, f"{d}/agentic_change_lo[g].parquet"), tracked_list(table(spark, d, "tracked_tables")), out, strict=True).awaitTermination()
        outcome = "drained"
    except StreamingQueryException as e:
        outcome = "refused" if "BadChange" in str(e) else "failed"
    return spark.createDataFrame([(outcome,)], "outcome string")


def st_seed(spark: SparkSession, d: str) -> DataFrame:
    """A sink seeded with a baseline: its refs come first, later batches follow in seal order."""
    sink = capture.SegmentSink(scratch(spark, "seed"), [{"table_name": "customer", "seal_seq": 0, "pk_lo": "0", "pk_hi": "0", "event_count": 0}])
    sink(_states(spark, d)[1].select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("pk"), "c_name"), 0)
    return sink.manifest(spark).select("table_name", F.col("seal_seq").cast("int").alias("seal_seq"), "event_count")


def vc_status(spark: SparkSession, d: str) -> DataFrame:
    c = commits_of(spark, d)
    return c.groupBy("branch").agg(F.max("committed_at").alias("last"), F.count("*").alias("n"))


def _committed(spark: SparkSession, d: str) -> tuple[Store, str, str]:
    s = _store(spark)
    m1 = s.snapshot(_tables(spark, d), "0.1.0")
    a = s.commit("main", "baseline", NOW, prompts={"system.txt": "one"}, memory_snapshot=m1, schema_version="0.1.0")
    more = table(spark, d, "part").select("p_partkey", F.lit(None).cast("string").alias("p_name"), F.lit("delete").alias("_op"), F.col("p_partkey").alias("_at")).where("p_size > 25")
    b = s.commit("main", "bad", NOW, prompts={"system.txt": "two"}, memory_snapshot=s.append(m1, {"part": more}), schema_version="0.1.0")
    return s, a, b


def vc_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark)
    return s.restore(s.snapshot(_tables(spark, d), "0.1.0"), "part", "0.1.0").select("p_partkey", "p_name", "p_size")


def vc_commit(spark: SparkSession, d: str) -> DataFrame:
    s, _, b = _committed(spark, d)
    return s.restore(s.read_commit(b).memory_snapshot, "part").select("p_partkey", "p_name", "p_size")


def vc_stage(spark: SparkSession, d: str) -> DataFrame:
    s, _, _ = _committed(spark, d)
    return spark.createDataFrame([(c.message, sorted(c.prompts)) for _, c in s.log()], "message string, prompts array<string>")


def vc_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Back to the baseline past a migration, with its token; the commit that holds the migration has one more column and fewer rows."""
    s, a, b = _committed(spark, d)
    tables = {t: s.restore(s.read_commit(b).memory_snapshot, t) for t in ("customer", "part")}
    tables["part"] = tables["part"].withColumn("p_note", F.lit("new"))
    s.commit("main", "migrated", NOW, prompts={"system.txt": "three"}, memory_snapshot=s.snapshot(tables, "0.2.0"), schema_version="0.2.0")
    token = approval.issue(b"key", "reverse_migration", a, 7, int(NOW.timestamp()))
    down = {"0.2.0": lambda t, df: df.drop("p_note")}
    c = s.rollback(a, NOW, migrations=["0.1.0", "0.2.0"], down=down, token=token, uid=7, keep_present=True)
    now, before = s.restore(s.read_commit(c).memory_snapshot, "part", "0.1.0"), s.restore(s.present_before(c), "part", "0.1.0")
    back = now.join(before.select("p_partkey"), "p_partkey", "left_anti").count()
    if back != now.where("p_size > 25").count() or before.columns != now.columns:
        raise AssertionError("what the rollback took back is not what had been deleted")
    return now.select("p_partkey", "p_name", "p_size")


def vc_reverse_migrate(spark: SparkSession, d: str) -> DataFrame:
    s, a, _ = _committed(spark, d)
    m = s.reverse_migrate(s.read_commit(a).memory_snapshot, [("0.1.0", lambda t, df: df.drop("p_retailprice") if t == "part" else df)], "0.0.0")
    return s.restore(m, "part", "0.0.0")


def vc_checkpointer(spark: SparkSession, d: str) -> DataFrame:
    c = Checkpointer(_store(spark))
    for k in range(3):
        c.put("thread", ("bytes", b"state %d" % k), ("bytes", b"{}"), NOW)
    return spark.createDataFrame([(p[0], p[1].decode()) for p, _ in c.list("thread")], "type string, data string")


QUERIES = {f.__name__: f for f in (snk_fs_store, src_body_cap, src_prompt_dir, st_capture, st_drain_strict, st_seed, vc_status, vc_snapshot, vc_commit, vc_stage, vc_rollback, vc_reverse_migrate, vc_checkpointer)}
_OLD = "(SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment <> 'BUILDING')"
_NEW = "(SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_nationkey <> 3)"
SQL = {
    "src_prompt_dir": f"SELECT name, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size FROM {files('prompts')} WHERE commit_hash = {TIP}",
    "snk_fs_store": f"SELECT DISTINCT hash, true AS intact, strlen(text) AS size FROM {files('tools')}",
    "src_body_cap": f"SELECT commit_hash, name, strlen(text) AS size FROM {files('tools')} WHERE strlen(text) <= 1048576",
    "st_capture": f"SELECT 'customer' AS table_name, CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(n.c_custkey, o.c_custkey) AS pk FROM {_OLD} o FULL JOIN {_NEW} n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_name <> n.c_name",
    "st_drain_strict": f"SELECT CASE WHEN count(*) FILTER (({PROBLEM}) IS NOT NULL) > 0 THEN 'refused' ELSE 'drained' END AS outcome FROM {READ_LOG}",
    "st_seed": f"SELECT 'customer' AS table_name, 0 AS seal_seq, 0::BIGINT AS event_count UNION ALL SELECT 'customer', 1, count(*) FROM {_NEW}",
    "vc_stage": "SELECT * FROM (VALUES ('bad', ['system.txt']), ('baseline', ['system.txt'])) t(message, prompts)",
    "vc_checkpointer": "SELECT 'bytes' AS type, 'state 2' AS data",
    "vc_status": f"SELECT branch, max(committed_at) AS last, count(*) AS n FROM {COMMITS} GROUP BY 1",
    "vc_snapshot": "SELECT p_partkey, p_name, p_size FROM part",
    "vc_commit": "SELECT p_partkey, p_name, p_size FROM part WHERE NOT p_size > 25",
    "vc_rollback": "SELECT p_partkey, p_name, p_size FROM part",
    "vc_reverse_migrate": "SELECT * EXCLUDE (p_retailprice) FROM part",
}
