"""One query per operator of the version store, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents, scalars
from ..functions.keys import reference
from ..functions.names import bare_name, normal_name, resolve, tracked_list
from ..operators import changes, folds, hierarchy, restoring, scanning, snapshots, trees
from ..session import cut, scratch, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def norm(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), '')"


def clean(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


NAME = "lower(replace(trim(table_name), '\"', ''))"
RESOLVED = f"""CASE WHEN {NAME} IN ('public.episodes', 'episodes') THEN 'public.episodes' WHEN {NAME} IN ('public.messages', 'messages') THEN 'messages'
  WHEN {NAME} IN ('public.checkpoints', 'checkpoints') THEN 'public.checkpoints' WHEN {NAME} IN ('agent.facts', 'facts') THEN 'agent.facts' END"""
COMMITS = f"""(SELECT {norm('commit_hash')} AS commit_hash, arg_min({norm('parent')}, committed_at) AS parent, arg_min({norm('memory_snapshot')}, committed_at) AS memory_snapshot, arg_min(branch, committed_at) AS branch,
  arg_min(author, committed_at) AS author, arg_min(message, committed_at) AS message, min(committed_at) AS committed_at, arg_min(code_sha, committed_at) AS code_sha, arg_min(model, committed_at) AS model,
  arg_min(schema_version, committed_at) AS schema_version FROM commits GROUP BY 1)"""


def files(tree: str) -> str:
    return f"""(SELECT commit_hash, e.key AS name, min(e.value) AS text, sha256(coalesce(min(e.value), '')) AS hash FROM (SELECT {norm('commit_hash')} AS commit_hash, unnest(map_entries({tree})) AS e FROM commits) GROUP BY 1, 2)"""


LINKS = f"(SELECT a.commit_hash, a.parent FROM {COMMITS} a WHERE a.parent IN (SELECT {norm('commit_hash')} FROM commits))"
ENTRIES = f"""(SELECT manifest, unnest(generate_series(0, len(entries) - 1)) AS pos, unnest(entries) AS e FROM (SELECT {norm('manifest')} AS manifest, arg_min(entries, stored_at) AS entries FROM segment_manifests GROUP BY 1))"""
SEGMENTS = f"""(SELECT {norm('segment')} AS segment, arg_max(table_name, len(rows)) AS table_name, arg_max(rows, len(rows)) AS rows FROM segments WHERE rows IS NOT NULL GROUP BY 1)"""
ELEMENTS = f"""(SELECT segment, table_name, "at", coalesce(CASE WHEN json_exists(j, '$.row') THEN lower(j->>'$.op') END, 'insert') AS op, CASE WHEN json_exists(j, '$.row') AND json_exists(j, '$.op') THEN j->'$.row' ELSE j END AS row
  FROM (SELECT segment, table_name, unnest(generate_series(0, len(rows) - 1)) AS "at", unnest(rows)::JSON AS j FROM {SEGMENTS}))"""
KEYED = f"""(SELECT *, regexp_replace(coalesce(row->>'$.fact_id', row->>'$.checkpoint_id', row->>'$.id'), '\\.0+$', '') AS pk FROM {ELEMENTS})"""


def commits_of(spark: SparkSession, d: str) -> DataFrame:
    return trees.one_each(table(spark, d, "commits"))


def entries_of(spark: SparkSession, d: str, tree: str = "prompts") -> DataFrame:
    return trees.tree_entries(table(spark, d, "commits"), tree)


def tracked_of(spark: SparkSession, d: str):
    return tracked_list(table(spark, d, "tracked_tables"))


def manifest_entries(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "segment_manifests").select(reference(F.col("manifest")).alias("manifest"), "stored_at", "taken_at", "entries").where("manifest is not null")
    one = one.groupBy("manifest").agg(F.min_by("entries", F.coalesce("stored_at", "taken_at")).alias("entries"))
    return one.select("manifest", F.posexplode("entries").alias("pos", "e")).select("manifest", "pos", "e.table_name", "e.pk_lo", "e.pk_hi", reference(F.col("e.segment")).alias("segment"), "e.row_count", F.col("pos").alias("seal_seq"))


# sources and sinks


@query(
    "SELECT 'customer' AS name, count(*) AS n, min(c_custkey) AS pk_lo, max(c_custkey) AS pk_hi FROM customer UNION ALL SELECT 'orders', count(*), min(o_orderkey), max(o_orderkey) FROM orders"
    " UNION ALL SELECT 'part', count(*), min(p_partkey), max(p_partkey) FROM part UNION ALL SELECT 'supplier', count(*), min(s_suppkey), max(s_suppkey) FROM supplier"
)
def src_table_scan(spark, d):
    each = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.min(k).alias("pk_lo"), F.max(k).alias("pk_hi")) for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_custkey")
def src_ordered_scan(spark, d):
    return folds.ordered_scan(table(spark, d, "customer"), "c_custkey", "customer").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR AS js FROM customer")
def src_row_to_json(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("js"))


@query("SELECT event_type, count(*) FILTER (isnan(v) OR isinf(v)) AS n_bad, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'error' THEN 'nan'::DOUBLE WHEN 'signup' THEN 'inf'::DOUBLE ELSE value END AS v FROM events) GROUP BY 1")
def src_finite_check(spark, d):
    v = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "signup", float("inf")).otherwise(F.col("value"))
    return table(spark, d, "events").withColumn("v", v).groupBy("event_type").agg(F.count_if(folds.non_finite(F.col("v"))).alias("n_bad"), F.count("*").alias("n"))


@query("SELECT DISTINCT id, table_name FROM agentic_change_log ORDER BY id LIMIT 1000")
def src_change_log(spark, d):
    return table(spark, d, "agentic_change_log").select("id", "table_name").distinct().orderBy("id").limit(1000)  # a batch of the log


@query("SELECT p_partkey, p_name, p_size FROM part")
def snk_segment(spark, d):
    from ..store import write_segment

    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    path = write_segment(rows, scratch(spark, "segments"), "part", 0)
    return spark.read.parquet(path)


# filters and validation


@query(f"SELECT {RESOLVED} AS tracked, count(*) AS n FROM agentic_change_log GROUP BY 1")
def flt_tracked(spark, d):
    return table(spark, d, "agentic_change_log").groupBy(resolve(F.col("table_name"), tracked_of(spark, d)).alias("tracked")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT table_name, {RESOLVED} AS tracked FROM agentic_change_log")
def flt_table_resolver(spark, d):
    return table(spark, d, "agentic_change_log").select("table_name", resolve(F.col("table_name"), tracked_of(spark, d)).alias("tracked")).distinct()


@query(f"SELECT DISTINCT table_name, regexp_extract({NAME}, '[^.]*$') AS bare FROM agentic_change_log")
def flt_bare_name(spark, d):
    return table(spark, d, "agentic_change_log").select("table_name", bare_name(normal_name(F.col("table_name"))).alias("bare")).distinct()


@query(f"SELECT op, coalesce({clean('op')} IN ('insert', 'update', 'delete'), false) AS known, count(*) AS n FROM agentic_change_log GROUP BY 1, 2")
def flt_op_domain(spark, d):
    op = F.lower(F.regexp_replace(F.col("op"), r"^\s+|\s+$", ""))
    return table(spark, d, "agentic_change_log").groupBy("op", F.coalesce(op.isin("insert", "update", "delete"), F.lit(False)).alias("known")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT t AS table_name, count(*) AS n, count(*) FILTER (coalesce(k, '') = '') AS n_void FROM (SELECT t, CASE t WHEN 'agent.facts' THEN row->>'$.fact_id' WHEN 'public.checkpoints' THEN row->>'$.checkpoint_id' ELSE row->>'$.id' END AS k FROM
  (SELECT t, CASE WHEN json_exists(j, '$.row') AND json_exists(j, '$.op') THEN j->'$.row' ELSE j END AS row FROM (SELECT {RESOLVED} AS t, CASE WHEN json_valid(row) THEN row::JSON END AS j FROM agentic_change_log))) WHERE t IS NOT NULL GROUP BY 1"""
)
def flt_pk_not_null(spark, d):
    rows = restoring.classify_changes(table(spark, d, "agentic_change_log"), tracked_of(spark, d)).where("table_name is not null")
    return rows.groupBy("table_name").agg(F.count("*").alias("n"), F.count_if(F.col("pk").isNull()).alias("n_void"))


@query("SELECT DISTINCT table_name, regexp_full_match(table_name, '[A-Za-z0-9_.]+') AS ok FROM agentic_change_log")
def flt_identifier(spark, d):
    return table(spark, d, "agentic_change_log").select("table_name", scalars.valid_identifier(F.col("table_name")).alias("ok")).distinct()


BRANCHES = "(SELECT DISTINCT b FROM (SELECT unnest([branch, '/' || branch, branch || '/', branch || '.tmp', branch || '/../x', upper(branch), branch || '\\x', 'HEAD', '', './' || branch, branch || '//x']) AS b FROM commits))"


def _variants(c, *more):
    return F.explode(F.array(c, *more))


@query(f"SELECT b, NOT (b = '' OR b = 'HEAD' OR contains(b, '\\') OR regexp_matches(b, '[\\x00-\\x1f\\x7f]') OR list_bool_or([x IN ('', '.', '..') OR ends_with(x, '.tmp') FOR x IN string_split(b, '/')])) AS ok FROM {BRANCHES} WHERE b IS NOT NULL")
def flt_branch_name(spark, d):
    b, lit, cat = F.col("branch"), F.lit, F.concat
    names = table(spark, d, "commits").select(_variants(b, cat(lit("/"), b), cat(b, lit("/")), cat(b, lit(".tmp")), cat(b, lit("/../x")), F.upper(b), cat(b, lit("\\x")), lit("HEAD"), lit(""), cat(lit("./"), b), cat(b, lit("//x"))).alias("b")).distinct()
    return names.where("b is not null").select("b", scalars.valid_branch_name(F.col("b")).alias("ok"))


@query("SELECT DISTINCT n AS name, NOT (n = '' OR starts_with(n, '/') OR list_contains(string_split(n, '/'), '..') OR split_part(n, '/', 1) = '.') AS ok FROM (SELECT unnest([k, '/' || k, '../' || k, k || '/..', './' || k, k || '/./x', '']) AS n FROM (SELECT unnest(map_keys(prompts)) AS k FROM commits))")
def flt_tree_name(spark, d):
    k, lit, cat = F.col("k"), F.lit, F.concat
    names = table(spark, d, "commits").select(F.explode(F.map_keys("prompts")).alias("k")).select(_variants(k, cat(lit("/"), k), cat(lit("../"), k), cat(k, lit("/..")), cat(lit("./"), k), cat(k, lit("/./x")), lit("")).alias("name")).distinct()
    return names.select("name", scalars.valid_tree_name(F.col("name")).alias("ok"))


def _with_directories(spark, d):
    e = entries_of(spark, d).select("commit_hash", "name")
    return e.unionByName(e.select("commit_hash", F.upper(F.split_part("name", F.lit("/"), F.lit(1))).alias("name"))).distinct()


@query(
    f"""WITH n AS (SELECT DISTINCT commit_hash, unnest([name, upper(split_part(name, '/', 1))]) AS name FROM {files('prompts')})
  SELECT a.commit_hash, a.name AS file, b.name AS inside FROM n a JOIN n b ON a.commit_hash = b.commit_hash AND starts_with(lower(b.name), lower(a.name) || '/')"""
)
def flt_file_dir_conflict(spark, d):
    return trees.file_directory_conflicts(_with_directories(spark, d), "commit_hash")


@query("SELECT n AS name, NOT (contains(n, '/') OR contains(n, '\\') OR contains(n, '..')) AS ok FROM (SELECT unnest([name, '../' || name, name || '\\x', 'a..b' || name]) AS n FROM agentic_migrations)")
def flt_migration_name(spark, d):
    n, lit, cat = F.col("name"), F.lit, F.concat
    return table(spark, d, "agentic_migrations").select(_variants(n, cat(lit("../"), n), cat(n, lit("\\x")), cat(lit("a..b"), n)).alias("name")).select("name", scalars.valid_migration_name(F.col("name")).alias("ok"))


IRREVERSIBLE = "CASE WHEN id > 5 THEN chr(10) || '  -- IRREVERSIBLE: ' || name ELSE 'drop table t;' || chr(10) || '-- IRREVERSIBLE' END"


@query(f"SELECT id, starts_with(ltrim({IRREVERSIBLE}, chr(10) || ' '), '-- IRREVERSIBLE') AS marked FROM agentic_migrations")
def flt_irreversible(spark, d):
    text = F.when(F.col("id") > 5, F.concat(F.lit("\n  -- IRREVERSIBLE: "), "name")).otherwise(F.lit("drop table t;\n-- IRREVERSIBLE"))
    return table(spark, d, "agentic_migrations").select("id", scalars.irreversible(text).alias("marked"))


@query(f"SELECT commit_hash, NOT (memory_snapshot IS NOT NULL AND schema_version IS NULL) AS ok FROM {COMMITS}")
def flt_target_shape(spark, d):
    return commits_of(spark, d).select("commit_hash", (~(F.col("memory_snapshot").isNotNull() & F.col("schema_version").isNull())).alias("ok"))


URL = r"[a-z]+://[^\s''\"`,)\]}<>]+".replace("''", "'")
URL_SQL = URL.replace("'", "''")
URLS = f"(SELECT DISTINCT u FROM (SELECT unnest(regexp_extract_all(text, '{URL_SQL}')) AS u FROM {files('tools')}) UNION SELECT unnest(['http://127.0.0.1:8080/x', 'http://localhost/y', 'http://[::1]:1/z', 'http://10.0.0.1/', 'ftp://localhost/', 'http://user@localhost:1/'])"


def _urls(spark, d):
    found = entries_of(spark, d, "tools").select(F.explode(F.regexp_extract_all("text", F.lit(f"({URL})"), 1)).alias("u"))
    more = spark.createDataFrame([(u,) for u in ("http://127.0.0.1:8080/x", "http://localhost/y", "http://[::1]:1/z", "http://10.0.0.1/", "ftp://localhost/", "http://user@localhost:1/")], "u string")
    return found.unionByName(more).distinct()


@query(
    f"""SELECT u AS url, (scheme = 'https' AND host <> '') OR (scheme = 'http' AND (host IN ('localhost', '[::1]') OR regexp_full_match(host, '127\\.\\d+\\.\\d+\\.\\d+'))) AS ok FROM
  (SELECT u, lower(regexp_extract(u, '^([a-z]+)://', 1)) AS scheme, lower(regexp_extract(u, '^[a-z]+://(?:[^/@]*@)?(\\[[^\\]]*\\]|[^/:?#]*)', 1)) AS host FROM {URLS}))"""
)
def flt_mcp_url(spark, d):
    return _urls(spark, d).select(F.col("u").alias("url"), scalars.valid_endpoint(F.col("u")).alias("ok"))


@query("SELECT DISTINCT p AS prefix, p <> '' AND trim(p) = p AND NOT starts_with(p, '/') AND ends_with(p, '/') AS ok FROM (SELECT unnest([k, split_part(k, '/', 1) || '/', ' ' || k || '/', '/' || k || '/', '']) AS p FROM (SELECT unnest(map_keys(prompts)) AS k FROM commits))")
def flt_exempt_prefix(spark, d):
    k, lit, cat = F.col("k"), F.lit, F.concat
    p = table(spark, d, "commits").select(F.explode(F.map_keys("prompts")).alias("k")).select(_variants(k, cat(F.split_part(k, lit("/"), lit(1)), lit("/")), cat(lit(" "), k, lit("/")), cat(lit("/"), k, lit("/")), lit("")).alias("prefix")).distinct()
    return p.select("prefix", scalars.valid_exempt_prefix(F.col("prefix")).alias("ok"))


@query(f"SELECT DISTINCT hash, coalesce(CASE WHEN json_valid(text) THEN (text::JSON)->>'$.kind' END IN ('tree', 'commit'), false) AS ambiguous FROM {files('prompts')}")
def flt_ambiguous_blob(spark, d):
    kind = F.try_variant_get(F.try_parse_json("text"), "$.kind", "string")
    return entries_of(spark, d).select("hash", F.coalesce(kind.isin("tree", "commit"), F.lit(False)).alias("ambiguous")).distinct()


@query(f"SELECT table_name, op, count(*) AS n, count(DISTINCT pk) AS n_keys FROM {KEYED} GROUP BY 1, 2")
def prj_envelope(spark, d):
    return restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d)).groupBy("table_name", "op").agg(F.count("*").alias("n"), F.count_distinct("pk").alias("n_keys"))


@query(f"SELECT commit_hash, message, author, strftime(committed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM {COMMITS}")
def prj_log_entry(spark, d):
    return commits_of(spark, d).select("commit_hash", "message", "author", scalars.rfc3339(F.col("committed_at")).alias("at"))


@query(f"SELECT commit_hash, substr(commit_hash, 1, 7) AS short FROM {COMMITS}")
def prj_short_hash(spark, d):
    return commits_of(spark, d).select("commit_hash", scalars.short_hash(F.col("commit_hash")).alias("short"))


@query(f"SELECT commit_hash, substr(commit_hash, 1, 2) || '/' || substr(commit_hash, 3, 62) AS path FROM {COMMITS}")
def prj_shard(spark, d):
    return commits_of(spark, d).select("commit_hash", scalars.shard(F.col("commit_hash")).alias("path"))


@query(f"SELECT u AS url, regexp_replace(u, '^([^:]*://[^:@]*):[^@]*@', '\\1:***@') AS redacted FROM {URLS})")
def prj_redact_url(spark, d):
    return _urls(spark, d).select(F.col("u").alias("url"), scalars.redact_url(F.col("u")).alias("redacted"))


@query(f"SELECT commit_hash, substr(regexp_replace(coalesce(model, ''), '^[^:]*:', ''), 1, 8) AS prefix FROM {COMMITS}")
def prj_token_prefix(spark, d):
    return commits_of(spark, d).select("commit_hash", scalars.token_prefix(F.coalesce("model", F.lit(""))).alias("prefix"))


# keyed lookups

DIFF = """(SELECT coalesce(n.commit_hash, o.commit_hash) AS commit_hash, coalesce(n.name, o.name) AS name, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'modified' END AS change, o.hash AS "from", n.hash AS "to"
  FROM (SELECT l.commit_hash, f.name, f.hash FROM {links} l JOIN {files} f ON f.commit_hash = l.parent) o FULL JOIN (SELECT l.commit_hash, f.name, f.hash FROM {links} l JOIN {files} f USING (commit_hash)) n
  ON o.commit_hash = n.commit_hash AND o.name = n.name WHERE o.hash IS DISTINCT FROM n.hash)"""


def diff_sql(tree: str) -> str:
    return DIFF.format(links=LINKS, files=files(tree))


@query(f"SELECT * FROM {diff_sql('prompts')}")
def jn_tree_diff(spark, d):
    return trees.tree_diffs(table(spark, d, "commits"), "prompts")


@query(f"SELECT manifest, pos, {norm('e.segment')} AS segment, len(s.rows) AS n_rows FROM {ENTRIES} LEFT JOIN {SEGMENTS} s ON s.segment = {norm('e.segment')}")
def jn_segment_fetch(spark, d):
    sizes = snapshots.segment_sizes(table(spark, d, "segments"))
    return manifest_entries(spark, d).join(sizes, "segment", "left").select("manifest", "pos", "segment", "n_rows")


@query(f"SELECT commit_hash, name, hash, strlen(text) AS size FROM {files('tools')}")
def jn_tree_blobs(spark, d):
    e = entries_of(spark, d, "tools")
    blobs = e.groupBy("hash").agg(F.min("text").alias("text")).withColumn("size", scalars.encoded_len(F.col("text"))).drop("text")
    return e.drop("text").join(blobs, "hash").select("commit_hash", "name", "hash", "size")


TIP = f"(SELECT commit_hash FROM {COMMITS} WHERE branch = 'main' ORDER BY committed_at DESC, commit_hash LIMIT 1)"
WALK = f"""WITH RECURSIVE c AS MATERIALIZED (SELECT commit_hash, parent, message FROM {COMMITS}), w AS (SELECT commit_hash, parent, 0 AS depth FROM c WHERE commit_hash = {TIP}
  UNION ALL SELECT c.commit_hash, c.parent, depth + 1 FROM w JOIN c ON c.commit_hash = w.parent WHERE depth < 10000)"""


def _tip(spark, d):
    return commits_of(spark, d).where("branch = 'main'").orderBy(F.desc("committed_at"), "commit_hash").limit(1).select(F.col("commit_hash").alias("id"))


def _history(spark, d, steps=None):
    links = cut(trees.against_parent(commits_of(spark, d)).select(F.col("commit_hash").alias("id"), "parent"))
    return hierarchy.chain(links, _tip(spark, d), steps).select(F.col("id").alias("commit_hash"), F.col("distance").alias("depth"))


@query(f"{WALK} SELECT commit_hash, depth::BIGINT AS depth FROM w")
def jn_parent_walk(spark, d):
    return _history(spark, d)


@query("SELECT id, name FROM agentic_migrations WHERE id > (SELECT id FROM agentic_migrations WHERE name = '0.3.0') ORDER BY id DESC")
def jn_migrations_after(spark, d):
    m = table(spark, d, "agentic_migrations").select("id", "name")
    return m.join(m.where("name = '0.3.0'").select(F.col("id").alias("target")), F.col("id") > F.col("target")).select("id", "name").orderBy(F.desc("id"))


@query(f"SELECT l.commit_hash, f.name FROM {LINKS} l JOIN {files('tools')} f ON f.commit_hash = l.parent ANTI JOIN {files('tools')} n ON n.commit_hash = l.commit_hash AND n.name = f.name")
def jn_orphans(spark, d):
    e = entries_of(spark, d, "tools").select("commit_hash", "name")
    present = trees.against_parent(commits_of(spark, d)).join(e.withColumnRenamed("commit_hash", "parent"), "parent").select("commit_hash", "name")
    return present.join(e, ["commit_hash", "name"], "left_anti")


@query(f"SELECT branch, parent, count(*) AS n FROM {COMMITS} c WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM commits x WHERE {norm('x.commit_hash')} = c.parent) GROUP BY 1, 2")
def jn_dangling_refs(spark, d):
    c = commits_of(spark, d)
    return c.where("parent is not null").join(c.select(F.col("commit_hash").alias("parent")), "parent", "left_anti").groupBy("branch", "parent").agg(F.count("*").alias("n"))


def contents(tree: str) -> str:
    return f"(SELECT DISTINCT hash, text FROM {files(tree)})"


def run_entropy(run: str) -> str:
    chars = f"string_split({run}, '')"
    return f"round(list_sum([-(len(list_filter({chars}, lambda y: y = x)) / len({run})) * log2(len(list_filter({chars}, lambda y: y = x)) / len({run})) FOR x IN list_distinct({chars})]), 6)"


RUNS = f"(SELECT hash, run, {run_entropy('run')} AS entropy FROM (SELECT hash, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{20,}}')) AS run FROM {contents('prompts')}))"


def _contents(spark, d, tree="prompts"):
    return entries_of(spark, d, tree).groupBy("hash").agg(F.min("text").alias("text"))


@query(f"SELECT hash, count(*) AS n FROM {RUNS} WHERE entropy > 4.5 AND hash NOT IN (SELECT hash FROM {files('prompts')} WHERE name = 'rules.txt') GROUP BY 1")
def jn_allowlist(spark, d):
    e = entries_of(spark, d)
    hits = scanning.entropy_runs(e.groupBy("hash").agg(F.min("text").alias("text")), "hash", "text").where("high")
    return scanning.unlisted(hits, e.where("name = 'rules.txt'").select("hash").distinct(), "hash").groupBy("hash").agg(F.count("*").alias("n"))


# aggregations and folds


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def agg_lww_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return folds.last_writer_wins(e, ["user_id"], ["event_id"], F.col("event_type") == "error").select("user_id", "event_type", "value", "event_id")


@query(
    """WITH e AS (SELECT *, coalesce(max(event_id) FILTER (event_type = 'error') OVER (PARTITION BY user_id), -1) AS gone FROM events)
  SELECT user_id, arg_max(value, event_id) FILTER (event_type IN ('purchase', 'signup')) AS value, arg_max(props, event_id) FILTER (event_type IN ('click', 'view')) AS props FROM e WHERE event_id > gone GROUP BY 1"""
)
def agg_upsert(spark, d):
    kind = F.col("event_type")
    return folds.partial_upsert(table(spark, d, "events"), "user_id", "event_id", kind == "error", {"value": kind.isin("purchase", "signup"), "props": kind.isin("click", "view")})


@query("SELECT user_id, max(event_id) AS deleted_at FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) = 'error'")
def agg_delete(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e"))
    return e.where("e.event_type = 'error'").select("user_id", F.col("e.event_id").alias("deleted_at"))


@query(f"SELECT table_name, op, count(*) AS n, count(*) FILTER (len(json_keys(row)) = 0) AS n_empty, count(*) FILTER (len(json_keys(row)) = 1) AS n_key_only FROM {ELEMENTS} GROUP BY 1, 2")
def agg_empty_row(spark, d):
    e = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d))
    width = F.size(F.json_object_keys(F.to_json("v")))
    return e.groupBy("table_name", "op").agg(F.count("*").alias("n"), F.count_if(width == 0).alias("n_empty"), F.count_if(width == 1).alias("n_key_only"))


@query(f"SELECT table_name, count(*) FILTER (n = 0 AND op <> 'delete') AS n_skipped, count(*) FILTER (n = 0 AND op = 'delete') AS n_refused, count(*) AS n FROM (SELECT table_name, op, len(json_keys(row)) AS n FROM {ELEMENTS}) GROUP BY 1")
def agg_empty_effect(spark, d):
    """What a replay makes of rows without any field: upserts are skipped, deletes refused."""
    e, delete = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d)), F.col("op") == "delete"
    return e.groupBy("table_name").agg(F.count_if(F.col("empty") & ~delete).alias("n_skipped"), F.count_if(F.col("empty") & delete).alias("n_refused"), F.count("*").alias("n"))


RUNNING = "(SELECT event_id, strlen(coalesce(props, '')) AS size, sum(strlen(coalesce(props, ''))) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events)"


def _sized(spark, d):
    return table(spark, d, "events").select("event_id", scalars.encoded_len(F.coalesce("props", F.lit(""))).alias("size"))


@query(f"SELECT ((running - size) // 4096)::BIGINT AS segment_no, count(*) AS n, sum(size)::BIGINT AS bytes, min(event_id) AS pk_lo, max(event_id) AS pk_hi FROM {RUNNING} GROUP BY 1")
def agg_pack(spark, d):
    packed = folds.pack_by_bytes(_sized(spark, d), ["event_id"], "size", 4096)
    return packed.groupBy("segment_no").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("event_id").alias("pk_lo"), F.max("event_id").alias("pk_hi"))


@query(
    f"""WITH RECURSIVE r AS MATERIALIZED {RUNNING}, g AS (SELECT 0 AS segment_no, (SELECT min(event_id) - 1 FROM r) AS lo, (SELECT min(event_id) FROM r WHERE running >= 4096) AS hi
    UNION ALL SELECT segment_no + 1, hi, (SELECT min(event_id) FROM r WHERE running >= (SELECT max(running) FROM r WHERE event_id = g.hi) + 4096) FROM g WHERE hi IS NOT NULL)
  SELECT segment_no::BIGINT AS segment_no, count(*) AS n, sum(size)::BIGINT AS bytes, min(event_id) AS pk_lo, max(event_id) AS pk_hi FROM g JOIN r ON event_id > lo AND event_id <= coalesce(hi, event_id) GROUP BY 1"""
)
def agg_pack_greedy(spark, d):
    """Packing as a writer does it: append, then seal when the target is reached."""
    packed = folds.pack_greedily(_sized(spark, d), "event_id", "size", 4096)
    return packed.groupBy("segment_no").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("event_id").alias("pk_lo"), F.max("event_id").alias("pk_hi"))


@query(f"SELECT segment, table_name, min(try_cast(pk AS BIGINT)) AS pk_lo, max(try_cast(pk AS BIGINT)) AS pk_hi, count(*) AS row_count FROM {KEYED} WHERE table_name IN ('messages', 'public.episodes') GROUP BY 1, 2")
def agg_pk_range(spark, d):
    e = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d)).where("table_name in ('messages', 'public.episodes')")
    return folds.key_ranges(e, ["segment", "table_name"], F.col("pk").try_cast("long"))


_PK_ORDER = "{'t': try_cast(pk AS DOUBLE) IS NULL, 'n': coalesce(try_cast(pk AS DOUBLE), 0), 'pk': pk}"


@query(f"SELECT segment, table_name, (min({_PK_ORDER}) FILTER (pk IS NOT NULL)).pk AS pk_lo, (max({_PK_ORDER}) FILTER (pk IS NOT NULL)).pk AS pk_hi, count(*) AS row_count FROM {KEYED} GROUP BY 1, 2")
def agg_pk_range_all(spark, d):
    """The ranges of agg_pk_range for all tables, in the order of srt_pk_key: numbers by value, then text."""
    is_text, num, _ = scalars.canonical_pk(F.col("pk"))
    key = F.when(F.col("pk").isNotNull(), F.struct(is_text.alias("t"), F.coalesce(num, F.lit(0.0)).alias("n"), "pk"))
    e = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d))
    return folds.key_ranges(e, ["segment", "table_name"], key).select("segment", "table_name", F.col("pk_lo.pk").alias("pk_lo"), F.col("pk_hi.pk").alias("pk_hi"), "row_count")


@query(f"SELECT manifest, count(*) AS n_entries, sum(e.row_count)::BIGINT AS event_count FROM {ENTRIES} GROUP BY 1")
def agg_row_count(spark, d):
    return manifest_entries(spark, d).groupBy("manifest").agg(F.count("*").alias("n_entries"), F.sum("row_count").alias("event_count"))


@query(f"SELECT commit_hash, sha256(string_agg(name || '=' || hash, chr(10) ORDER BY name, hash)) AS tree_hash, count(*) AS n FROM {files('prompts')} GROUP BY 1")
def agg_merkle(spark, d):
    return trees.tree_hashes(entries_of(spark, d))


@query(f"SELECT hash, run, entropy FROM {RUNS}")
def agg_entropy(spark, d):
    return scanning.entropy_runs(_contents(spark, d), "hash", "text").select("hash", "run", "entropy")


#: Depth by brackets: strings out, empty containers as scalars; each other container adds one level.
BARE = """regexp_replace(regexp_replace(text, '"(\\\\.|[^"\\\\])*"', 'x', 'g'), '[\\[{]\\s*[\\]}]', 'x', 'g')"""


@query(
    f"""SELECT depth, count(*) AS n FROM (SELECT hash, any_value(copies) AS copies, max(level)::INT + 1 AS depth FROM (SELECT hash, copies, sum(CASE WHEN c IN ('{{', '[') THEN 1 WHEN c IN ('}}', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY hash ORDER BY i) AS level
  FROM (SELECT hash, copies, unnest(string_split(b, '')) AS c, generate_subscripts(string_split(b, ''), 1) AS i FROM (SELECT hash, count(*) AS copies, any_value({BARE}) AS b FROM {files('tools')} WHERE json_valid(text) GROUP BY 1))) GROUP BY 1), range(copies) GROUP BY 1
  UNION ALL SELECT NULL, n FROM (SELECT count(*) AS n FROM {files('tools')} WHERE NOT coalesce(json_valid(text), false)) WHERE n > 0"""
)
def agg_json_depth(spark, d):
    """Depths of all files, null for those that are no JSON; each content is parsed once."""
    each = entries_of(spark, d, "tools").groupBy("hash").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    return each.groupBy(documents.json_depth("text").alias("depth")).agg(F.sum("copies").alias("n"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def agg_dedup(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(scalars.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("SELECT coalesce(arg_max(name, id), '0.0.0') AS version FROM agentic_migrations")
def agg_schema_version(spark, d):
    return table(spark, d, "agentic_migrations").agg(F.coalesce(F.max_by("name", "id"), F.lit("0.0.0")).alias("version"))


# sequences


@query(f"SELECT event_id, size, running::BIGINT AS running_bytes FROM {RUNNING}")
def win_running_bytes(spark, d):
    return folds.running_total(_sized(spark, d), ["event_id"], "size", "running_bytes")


@query(
    f"""SELECT manifest, count(*) FILTER (h < b) AS n_unsorted, count(*) FILTER (h = b) AS n_repeated, count(*) AS n_entries FROM
  (SELECT manifest, h, lag(h) OVER (PARTITION BY manifest ORDER BY pos) AS b FROM (SELECT manifest, pos, row(e.table_name, e.pk_lo, e.pk_hi) AS h FROM {ENTRIES})) GROUP BY 1"""
)
def win_adjacent_check(spark, d):
    return folds.adjacent_violations(manifest_entries(spark, d), "manifest", "pos")


def _key_sql(c):
    return f"row(try_cast({c} AS DOUBLE) IS NULL, coalesce(try_cast({c} AS DOUBLE), 0), trim({c}, '\"'))"


@query(
    f"""SELECT manifest, count(*) FILTER (h < b) AS n_unsorted, count(*) FILTER (h = b) AS n_repeated, coalesce(trim(any_value(version)) = '', true) AS no_version FROM
  (SELECT manifest, version, h, lag(h) OVER (PARTITION BY manifest ORDER BY pos) AS b FROM (SELECT e.manifest, e.pos, v.version, row(e.e.table_name, {_key_sql('e.e.pk_lo')}, {_key_sql('e.e.pk_hi')}) AS h FROM {ENTRIES} e
   JOIN (SELECT {norm('manifest')} AS manifest, arg_min(schema_version, stored_at) AS version FROM segment_manifests GROUP BY 1) v ON v.manifest = e.manifest)) GROUP BY 1"""
)
def win_manifest_check(spark, d):
    """All that a manifest is refused for: order and repeats by true key order, and an empty version."""
    versions = table(spark, d, "segment_manifests").select(reference(F.col("manifest")).alias("manifest"), "schema_version", F.coalesce("stored_at", "taken_at").alias("s")).groupBy("manifest").agg(F.min_by("schema_version", "s").alias("schema_version"))
    return folds.manifest_violations(manifest_entries(spark, d).join(versions, "manifest"), "manifest", "pos", F.col("schema_version"))


@query()
def win_replay_batches(spark, d):
    """Batches of replay: equal shape, no key twice, capped in rows and parameters."""
    e = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d))
    fields = F.json_object_keys(F.to_json("v"))
    mode = F.when(F.col("op") == "delete", "delete").otherwise("upsert")
    return folds.replay_batches(e, "segment", "at", F.concat(mode, F.lit(":"), F.array_join(F.array_sort(fields), ",")), F.col("pk"), F.size(fields))


@query(
    f"""SELECT segment, run, shape, min("at")::BIGINT AS first, count(*) AS n FROM (SELECT segment, "at", shape, sum(new) OVER (PARTITION BY segment ORDER BY "at") AS run FROM (SELECT segment, "at", shape, (lag(shape) OVER (PARTITION BY segment ORDER BY "at") IS DISTINCT FROM shape)::INT AS new
  FROM (SELECT segment, "at", op || ':' || array_to_string(list_sort(json_keys(row)), ',') AS shape FROM {ELEMENTS}))) GROUP BY 1, 2, 3"""
)
def win_same_shape_runs(spark, d):
    e = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d))
    shape = F.concat("op", F.lit(":"), F.array_join(F.array_sort(F.json_object_keys(F.to_json("v"))), ","))
    return folds.same_shape_runs(e, "segment", "at", shape).select("segment", F.col("run").cast("long").alias("run"), "shape", F.col("first").cast("long").alias("first"), "n")


@query(f"{WALK} SELECT commit_hash, depth + 1 AS position FROM w")
def win_log_depth(spark, d):
    return _history(spark, d).select("commit_hash", (F.col("depth") + 1).cast("int").alias("position"))


# sorts, limits


@query(f"SELECT manifest, e.table_name AS table_name, e.pk_lo AS pk_lo, e.pk_hi AS pk_hi, pos AS seal_seq FROM {ENTRIES} ORDER BY 2, 3, 4, 5")
def srt_manifest(spark, d):
    return folds.manifest_order(manifest_entries(spark, d)).select("manifest", "table_name", "pk_lo", "pk_hi", "seal_seq")


@query(f"SELECT manifest, pos, try_cast(e.pk_lo AS DOUBLE) IS NULL AS is_text, try_cast(e.pk_lo AS DOUBLE) AS num, trim(e.pk_lo, '\"') AS txt FROM {ENTRIES} ORDER BY 3, 4, 5")
def srt_pk_key(spark, d):
    rank, num, text = scalars.canonical_pk(F.col("pk_lo"))
    return manifest_entries(spark, d).select("manifest", "pos", rank.alias("is_text"), num.alias("num"), text.alias("txt")).orderBy("is_text", "num", "txt")


@query(f"SELECT commit_hash, name FROM {files('tools')} ORDER BY 1, 2")
def srt_tree(spark, d):
    return entries_of(spark, d, "tools").select("commit_hash", "name").orderBy("commit_hash", "name")


@query(f"{WALK} SELECT commit_hash, depth::BIGINT AS depth FROM w WHERE depth < 20 ORDER BY depth")
def srt_log_limit(spark, d):
    return _history(spark, d, 20).orderBy("depth")  # --limit, 20 unless given


@query("SELECT id, name FROM agentic_migrations ORDER BY id DESC")
def srt_migrations_desc(spark, d):
    return table(spark, d, "agentic_migrations").select("id", "name").orderBy(F.desc("id"))


@query("SELECT event_no, table_name, op FROM (SELECT DISTINCT event_no, table_name, op FROM change_events) ORDER BY event_no LIMIT 1000")
def srt_change_batch(spark, d):
    return table(spark, d, "change_events").select("event_no", "table_name", "op").distinct().orderBy("event_no").limit(1000)  # a batch


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 3")
def srt_example_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_orderkey")).limit(3)


# sets


@query(f"SELECT DISTINCT commit_hash, name FROM (SELECT l.commit_hash, f.name FROM {LINKS} l JOIN {files('prompts')} f ON f.commit_hash = l.parent UNION SELECT l.commit_hash, f.name FROM {LINKS} l JOIN {files('prompts')} f USING (commit_hash))")
def set_name_union(spark, d):
    e, links = entries_of(spark, d).select("commit_hash", "name"), trees.against_parent(commits_of(spark, d))
    return links.join(e.withColumnRenamed("commit_hash", "parent"), "parent").select("commit_hash", "name").union(links.select("commit_hash").join(e, "commit_hash")).distinct()


@query(f"SELECT DISTINCT table_name, segment FROM (SELECT e.table_name AS table_name, {norm('e.segment')} AS segment FROM {ENTRIES} UNION ALL SELECT table_name, {norm('segment')} FROM segments)")
def set_sealed_union(spark, d):
    sealed = table(spark, d, "segments").select("table_name", reference(F.col("segment")).alias("segment"))
    return manifest_entries(spark, d).select("table_name", "segment").unionByName(sealed).distinct()


@query(f"SELECT l.commit_hash, f.name, f.hash FROM {LINKS} l JOIN {files('prompts')} f USING (commit_hash) EXCEPT SELECT l.commit_hash, f.name, f.hash FROM {LINKS} l JOIN {files('prompts')} f ON f.commit_hash = l.parent")
def set_wanted_minus(spark, d):
    e, links = entries_of(spark, d).select("commit_hash", "name", "hash"), trees.against_parent(commits_of(spark, d))
    wanted = links.select("commit_hash").join(e, "commit_hash")
    return wanted.subtract(links.join(e.withColumnRenamed("commit_hash", "parent"), "parent").select("commit_hash", "name", "hash"))


@query(f"SELECT table_name, array_to_string(list_sort(json_keys(row)), ',') AS cols, count(*) AS n FROM {ELEMENTS} GROUP BY 1, 2")
def set_column_equality(spark, d):
    cols = F.array_join(F.array_sort(F.json_object_keys(F.to_json("v"))), ",")
    return restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d)).groupBy("table_name", cols.alias("cols")).agg(F.count("*").alias("n"))


# scalar functions


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def fn_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("hash"))


@query("SELECT DISTINCT memory_snapshot AS given, CASE WHEN regexp_full_match(memory_snapshot, '[0-9a-fA-F]{64}') THEN lower(memory_snapshot) END AS hash FROM commits")
def fn_parse_hash(spark, d):
    return table(spark, d, "commits").select(F.col("memory_snapshot").alias("given"), scalars.parse_hash(F.col("memory_snapshot")).alias("hash")).distinct()


@query("SELECT doc_id, lower(hex(source)) AS hx, base64(encode(source)) AS b64 FROM documents")
def fn_hex(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex("source")).alias("hx"), F.base64(F.col("source").cast("binary")).alias("b64"))


@query()
def fn_canonical_json(spark, d):
    return table(spark, d, "change_events").select("event_no", documents.canonical_json("row").alias("js"))


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def fn_encoded_len(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.encoded_len(F.col("text")).alias("n_bytes"))


PAIRS = f"(SELECT a.commit_hash, a.schema_version AS new_version, p.schema_version AS old_version, a.memory_snapshot AS new_snapshot, p.memory_snapshot AS old_snapshot, a.model AS new_model, p.model AS old_model FROM {COMMITS} a JOIN {COMMITS} p ON a.parent = p.commit_hash)"


def _pairs(spark, d):
    c = commits_of(spark, d)
    old = c.select(F.col("commit_hash").alias("parent"), F.col("schema_version").alias("old_version"), F.col("memory_snapshot").alias("old_snapshot"), F.col("model").alias("old_model"))
    return c.select("commit_hash", "parent", F.col("schema_version").alias("new_version"), F.col("memory_snapshot").alias("new_snapshot"), F.col("model").alias("new_model")).join(old, "parent")


@query(f'SELECT commit_hash, old_version AS "from", new_version AS "to" FROM {PAIRS} WHERE old_version IS DISTINCT FROM new_version')
def fn_string_change(spark, d):
    return _pairs(spark, d).select("commit_hash", scalars.changed(F.col("old_version"), F.col("new_version")).alias("c")).where("c is not null").select("commit_hash", "c.from", "c.to")


@query(f'SELECT commit_hash, old_snapshot AS "from", new_snapshot AS "to" FROM {PAIRS} WHERE old_snapshot IS DISTINCT FROM new_snapshot')
def fn_hash_change(spark, d):
    return _pairs(spark, d).select("commit_hash", scalars.changed(F.col("old_snapshot"), F.col("new_snapshot")).alias("c")).where("c is not null").select("commit_hash", "c.from", "c.to")


@query(f'SELECT commit_hash, old_model AS "from", new_model AS "to" FROM {PAIRS} WHERE old_model IS DISTINCT FROM new_model')
def fn_model_diff(spark, d):
    return _pairs(spark, d).select("commit_hash", scalars.changed(F.col("old_model"), F.col("new_model")).alias("c")).where("c is not null").select("commit_hash", "c.from", "c.to")


PATTERN_HITS = " UNION ALL ".join(f"SELECT hash, '{n}' AS kind, unnest([x[1] FOR x IN [[m] FOR m IN regexp_extract_all(text, '{p}')]]) AS hit FROM {contents('tools')}" for n, p in scalars.TOKEN_PATTERNS.items())


@query(f"SELECT hash, kind, len(hit) AS length, count(*) AS n FROM ({PATTERN_HITS}) GROUP BY 1, 2, 3")
def fn_scan_patterns(spark, d):
    return scanning.pattern_hits(_contents(spark, d, "tools"), "hash", "text")


@query(f"SELECT hash, run, entropy, entropy > 4.5 AS high FROM {RUNS}")
def fn_scan_entropy(spark, d):
    return scanning.entropy_runs(_contents(spark, d), "hash", "text")


@query(f"SELECT DISTINCT hash, 'high_entropy' AS kind FROM {RUNS} WHERE entropy > 4.5 AND hash NOT IN (SELECT hash FROM {files('prompts')} WHERE starts_with(name, 'config/')) UNION SELECT DISTINCT hash, kind FROM ({PATTERN_HITS.replace(contents('tools'), contents('prompts'))})")
def fn_scan_policy(spark, d):
    c = entries_of(spark, d).groupBy("hash").agg(F.min("text").alias("text"), F.max(F.col("name").startswith("config/")).alias("exempt"))
    return scanning.scan(c, "hash", "text", F.col("exempt"))


@query(f"SELECT b AS name, CASE WHEN b = 'HEAD' THEN (SELECT commit_hash FROM {COMMITS} WHERE branch = 'main' ORDER BY committed_at DESC, commit_hash LIMIT 1) WHEN regexp_full_match(b, '[0-9a-fA-F]{{64}}') THEN lower(b) ELSE (SELECT arg_max(commit_hash, committed_at) FROM {COMMITS} c WHERE c.branch = b) END AS hash FROM (SELECT DISTINCT unnest([branch, 'HEAD', 'no-such', repeat('AB', 32)]) AS b FROM commits) WHERE b IS NOT NULL")
def fn_resolve_ref(spark, d):
    c = commits_of(spark, d)
    tips = c.groupBy("branch").agg(F.max_by("commit_hash", "committed_at").alias("tip"))
    names = table(spark, d, "commits").select(F.explode(F.array("branch", F.lit("HEAD"), F.lit("no-such"), F.lit("AB" * 32))).alias("name")).distinct().where("name is not null")
    head = F.broadcast(_tip(spark, d).withColumnRenamed("id", "head"))  # one row
    hit = names.join(tips, names.name == tips.branch, "left").crossJoin(head)
    return hit.select("name", F.when(F.col("name") == "HEAD", F.col("head")).when(F.col("name").rlike("^[0-9a-fA-F]{64}$"), F.lower("name")).otherwise(F.col("tip")).alias("hash"))


@query()
def fn_thread_branch(spark, d):
    return table(spark, d, "documents").select(F.col("speaker").alias("thread")).distinct().select("thread", documents.thread_branch("thread").alias("branch"))


@query("SELECT event_no, row FROM change_events WHERE table_name LIKE '%checkpoints'")
def fn_checkpoint_codec(spark, d):
    part = lambda c: F.struct(F.lit("bytes").alias("type"), F.base64(c.cast("binary")).alias("data_b64"))
    env = table(spark, d, "change_events").where("table_name like '%checkpoints'").select("event_no", F.to_json(F.struct(F.lit(1).alias("v"), F.col("event_no").cast("string").alias("thread_id"), part(F.col("row")).alias("checkpoint"), part(F.col("op")).alias("metadata"))).alias("envelope"))
    x = F.from_json("envelope", "v int, thread_id string, checkpoint struct<type:string,data_b64:string>, metadata struct<type:string,data_b64:string>")
    ok = (F.col("x.v") == documents.ENVELOPE_VERSION) & F.col("x.checkpoint.type").isin(*documents.ENVELOPE_TYPES)
    return env.withColumn("x", x).where(ok).select("event_no", F.decode(F.unbase64("x.checkpoint.data_b64"), "UTF-8").alias("row"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events")
def fn_rfc3339(spark, d):
    return table(spark, d, "events").select("event_id", scalars.rfc3339(F.col("ts").cast("timestamp")).alias("at"))


@query(f"SELECT commit_hash, CASE change WHEN 'added' THEN '+ ' WHEN 'removed' THEN '- ' ELSE '~ ' END || name AS line FROM {diff_sql('tools')}")
def fn_rows_render(spark, d):
    return trees.tree_diffs(table(spark, d, "commits"), "tools").select("commit_hash", trees.render(F.col("change"), F.col("name")).alias("line"))


# streaming, as one batch over the whole feed

PROBLEM = f"""CASE WHEN id IS NULL THEN 'no id' WHEN t IS NULL THEN 'untracked table' WHEN NOT coalesce(o IN ('insert', 'update', 'delete'), false) THEN 'unknown op' WHEN j IS NULL THEN 'unreadable row'
  WHEN coalesce(CASE t WHEN 'agent.facts' THEN body->>'$.fact_id' WHEN 'public.checkpoints' THEN body->>'$.checkpoint_id' ELSE body->>'$.id' END, '') = '' THEN 'no key' END"""


@query(
    f"""SELECT coalesce({PROBLEM}, 'applied') AS outcome, count(*) AS n FROM (SELECT *, CASE WHEN json_exists(j, '$.row') AND json_exists(j, '$.op') THEN j->'$.row' ELSE j END AS body FROM
  (SELECT id, {RESOLVED} AS t, {clean('op')} AS o, CASE WHEN json_valid(row) THEN row::JSON END AS j FROM agentic_change_log)) GROUP BY 1"""
)
def st_drain_lenient(spark, d):
    return restoring.classify_changes(table(spark, d, "agentic_change_log"), tracked_of(spark, d)).groupBy(F.coalesce("problem", F.lit("applied")).alias("outcome")).agg(F.count("*").alias("n"))


# version control


@query(f"SELECT DISTINCT hash, strlen(text) AS size FROM {files('prompts')} UNION SELECT DISTINCT hash, strlen(text) FROM {files('tools')}")
def vc_stage_tree(spark, d):
    both = entries_of(spark, d).unionByName(entries_of(spark, d, "tools"))
    return both.groupBy("hash").agg(F.min("text").alias("text")).select("hash", scalars.encoded_len(F.col("text")).alias("size"))


@query(f"{WALK} SELECT w.commit_hash, c.message, w.depth::BIGINT AS depth FROM w JOIN c USING (commit_hash) WHERE w.depth < 20")
def vc_log(spark, d):
    return _history(spark, d, 20).join(commits_of(spark, d).select("commit_hash", "message"), "commit_hash").select("commit_hash", "message", "depth")


@query(f"SELECT branch, arg_max(commit_hash, committed_at) AS tip, count(*) AS n FROM {COMMITS} GROUP BY 1")
def vc_resolve(spark, d):
    return commits_of(spark, d).groupBy("branch").agg(F.max_by("commit_hash", "committed_at").alias("tip"), F.count("*").alias("n"))


SCALARS = " UNION ALL ".join(f'SELECT a.commit_hash, \'{n}\' AS dimension, p.{n} AS "from", a.{n} AS "to" FROM {COMMITS} a JOIN {COMMITS} p ON a.parent = p.commit_hash WHERE a.{n} IS DISTINCT FROM p.{n}' for n in ("code_sha", "model", "memory_snapshot", "schema_version"))


@query(
    f"""SELECT commit_hash, 'prompts' AS dimension, name, change, "from", "to" FROM {diff_sql('prompts')} UNION ALL SELECT commit_hash, 'tools', name, change, "from", "to" FROM {diff_sql('tools')}
  UNION ALL SELECT commit_hash, dimension, '', 'modified', "from", "to" FROM ({SCALARS})"""
)
def vc_diff(spark, d):
    return trees.commit_diffs(table(spark, d, "commits"))


@query(f"SELECT hash, strlen(text) AS size, text FROM {contents('tools')} WHERE strlen(text) <= 10485760")
def vc_cat_object(spark, d):
    c = _contents(spark, d, "tools").withColumn("size", scalars.encoded_len(F.col("text")))
    return c.where(F.col("size") <= 10 * 2**20).select("hash", "size", "text")


LIVE = f"""(SELECT manifest, table_name, pk, arg_max(op, row(pos, "at")) AS op FROM (SELECT manifest, pos, k.* FROM {ENTRIES} JOIN {KEYED} k ON k.segment = {norm('e.segment')}) GROUP BY 1, 2, 3)"""


@query(f"SELECT manifest, table_name, pk FROM {LIVE} WHERE op <> 'delete'")
def vc_restore(spark, d):
    events = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d))
    return restoring.live_places(manifest_entries(spark, d), events).select("manifest", "table_name", "pk")


@query(f"SELECT manifest, table_name, count(*) FILTER (op <> 'delete') AS live_count, count(*) AS n_keys FROM {LIVE} GROUP BY 1, 2")
def snk_table_restore(spark, d):
    events = restoring.envelopes(table(spark, d, "segments"), tracked_of(spark, d))
    rows = manifest_entries(spark, d).select("manifest", "pos", "segment").join(events.drop("v"), "segment")
    last = rows.groupBy("manifest", "table_name", "pk").agg(F.max(F.struct("pos", "at", "op")).alias("e"))
    return last.groupBy("manifest", "table_name").agg(F.count_if(F.col("e.op") != "delete").alias("live_count"), F.count("*").alias("n_keys"))


@query(
    f"""SELECT t.commit_hash AS parent, o.code_sha, o.model, o.memory_snapshot, o.schema_version, 'rollback' AS author, 'rollback to ' || o.commit_hash AS message FROM {TIP} t, {COMMITS} o WHERE o.commit_hash = (SELECT commit_hash FROM {COMMITS} WHERE branch = 'main' ORDER BY committed_at, commit_hash LIMIT 1)"""
)
def vc_forward_record(spark, d):
    c = commits_of(spark, d)
    first = c.where("branch = 'main'").orderBy("committed_at", "commit_hash").limit(1)
    new = restoring.forward_record(c, _tip(spark, d).withColumnRenamed("id", "commit_hash"), first, "rollback", "2026-01-01 00:00:00")
    return new.select("parent", "code_sha", "model", "memory_snapshot", "schema_version", "author", "message")


@query(f"SELECT hash, sha256(text) = hash AS intact FROM {contents('prompts')}")
def vc_integrity(spark, d):
    return _contents(spark, d).select("hash", (scalars.content_hash(F.col("text")) == F.col("hash")).alias("intact"))


def _tree_hash(tree):
    return f"(SELECT commit_hash, sha256(string_agg(name || '=' || hash, chr(10) ORDER BY name, hash)) AS h FROM {files(tree)} GROUP BY 1)"


def _part(name, value):
    return f"'{name}=' || coalesce(chr(39) || {value} || chr(39), 'null')"


@query(
    f"""SELECT commit_hash, sha256(concat_ws(chr(10), {', '.join(_part(n, v) for n, v in (("code_sha", "code_sha"), ("prompts", "p.h"), ("tools", "t.h"), ("model", "model"), ("memory_snapshot", "memory_snapshot"), ("schema_version", "schema_version")))})) AS tuple_hash
  FROM {COMMITS} c LEFT JOIN {_tree_hash('prompts')} p USING (commit_hash) LEFT JOIN {_tree_hash('tools')} t USING (commit_hash)"""
)
def vc_tuple_hash(spark, d):
    return trees.tuple_hash(table(spark, d, "commits"))


CHANGE_KEY = "CASE t WHEN 'agent.facts' THEN body->>'$.fact_id' WHEN 'public.checkpoints' THEN body->>'$.checkpoint_id' ELSE body->>'$.id' END"


@query(
    f"""SELECT t AS table_name, CASE WHEN regexp_full_match(k, '-?[0-9]+\\.0+') THEN regexp_replace(k, '\\.0+$', '') ELSE k END AS pk, max(id) AS id FROM (SELECT *, {CHANGE_KEY} AS k FROM (SELECT *, CASE WHEN json_exists(j, '$.row') AND json_exists(j, '$.op') THEN j->'$.row' ELSE j END AS body FROM
  (SELECT event_no AS id, {RESOLVED} AS t, {clean('op')} AS o, CASE WHEN json_valid(row) THEN row::JSON END AS j FROM change_events))) WHERE t IS NOT NULL AND o IN ('insert', 'update', 'delete') AND trim(k) <> '' GROUP BY 1, 2 HAVING arg_max(o, id) <> 'delete'"""
)
def agg_change_state(spark, d):
    """The fold of problem 1 over the second feed, whose order is event_no."""
    feed = table(spark, d, "change_events").withColumnRenamed("event_no", "id")
    return changes.live_rows(changes.read_changes(feed, tracked_of(spark, d))).select("table_name", "pk", "id")
