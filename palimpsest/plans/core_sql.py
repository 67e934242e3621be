"""SQL of the queries of problems 1, 2, 4, 5 and 6."""

from __future__ import annotations

from .reference_queries import COMMITS, ENTRIES, KEYED, RESOLVED, SEGMENTS, clean, norm

KEY = "CASE t WHEN 'agent.facts' THEN body->>'$.fact_id' WHEN 'public.checkpoints' THEN body->>'$.checkpoint_id' ELSE body->>'$.id' END"
PLAIN = "CASE WHEN regexp_full_match(k, '-?[0-9]+\\.0+') THEN regexp_replace(k, '\\.0+$', '') ELSE k END"
VALID = f"""(SELECT t AS table_name, {PLAIN} AS pk, id, o AS op FROM (SELECT *, {KEY} AS k FROM (SELECT *, CASE WHEN json_exists(j, '$.row') AND json_exists(j, '$.op') THEN j->'$.row' ELSE j END AS body FROM
  (SELECT id, {RESOLVED} AS t, {clean('op')} AS o, CASE WHEN json_valid(row) THEN row::JSON END AS j FROM agentic_change_log))) WHERE t IS NOT NULL AND o IN ('insert', 'update', 'delete') AND trim(k) <> '')"""

P1 = f"SELECT table_name, pk, max(id) AS id FROM {VALID} GROUP BY 1, 2 HAVING arg_max(op, id) <> 'delete'"


def _orphans(table: str, field: str, refs: str, target: str, until: str) -> str:
    return f"""SELECT DISTINCT '{table}' AS ref_table, '{field}' AS ref_field, record_key, missing_key, CASE WHEN key IS NULL THEN 'missing' WHEN {until} IS NOT NULL THEN 'deleted' ELSE 'late' END AS kind, strftime("at", '%Y-%m') AS period
  FROM (SELECT record_key, missing_key, min("at") AS "at" FROM {refs} WHERE record_key IS NOT NULL AND missing_key IS NOT NULL GROUP BY 1, 2) LEFT JOIN {target} ON key = missing_key WHERE key IS NULL OR {until} IS NOT NULL OR since > "at\""""


P2 = " UNION ALL ".join(
    (
        _orphans("commits", "parent", f"(SELECT {norm('commit_hash')} AS record_key, {norm('parent')} AS missing_key, committed_at AS \"at\" FROM commits)", f"(SELECT {norm('commit_hash')} AS key, min(committed_at) AS since, NULL::TIMESTAMP AS until FROM commits GROUP BY 1)", "until"),
        _orphans("commits", "memory_snapshot", f"(SELECT {norm('commit_hash')} AS record_key, {norm('memory_snapshot')} AS missing_key, committed_at AS \"at\" FROM commits)", f"(SELECT {norm('manifest')} AS key, min(stored_at) AS since, max(reclaimed_at) AS until FROM segment_manifests GROUP BY 1)", "until"),
        _orphans("segment_manifests", "segment", f"(SELECT {norm('manifest')} AS record_key, {norm('e.segment')} AS missing_key, taken_at AS \"at\" FROM (SELECT manifest, taken_at, unnest(entries) AS e FROM segment_manifests))", f"(SELECT {norm('segment')} AS key, min(stored_at) AS since, max(reclaimed_at) AS until FROM segments GROUP BY 1)", "until"),
    )
)
P2_REPORT = f"SELECT ref_table, ref_field, kind, period, count(*) AS n_refs, count(DISTINCT missing_key) AS n_keys FROM ({P2}) GROUP BY 1, 2, 3, 4"

#: A row by value: fields in order, numbers as double, nulls and the key field left out.
_VALUE = "list_sort(list_filter([f || '=' || coalesce(CASE WHEN json_type(row, '$.' || f) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'n' || (row->>('$.' || f))::DOUBLE WHEN json_type(row, '$.' || f) = 'NULL' THEN NULL WHEN json_type(row, '$.' || f) = 'VARCHAR' THEN 's' || (row->>('$.' || f)) WHEN json_type(row, '$.' || f) = 'OBJECT' THEN array_to_string(list_sort([g || ':' || (row->>('$.' || f || '.' || g)) FOR g IN json_keys(row, '$.' || f)]), ',') ELSE row->>('$.' || f) END, '') FOR f IN list_filter(json_keys(row), lambda f: NOT f IN ('id', 'fact_id', 'checkpoint_id') AND json_type(row, '$.' || f) <> 'NULL')], lambda x: x IS NOT NULL))"
P4 = f"""WITH m AS (SELECT {norm('manifest')} AS manifest, arg_min(workspace, stored_at) AS workspace, regexp_replace(lower(trim(arg_min(schema_version, stored_at))), '^v', '') AS version, arg_min(taken_at, stored_at) AS taken_at FROM segment_manifests GROUP BY 1),
  en AS MATERIALIZED (SELECT manifest, pos, e.table_name AS table_name, {norm('e.segment')} AS segment, e.row_count AS row_count FROM {ENTRIES}),
  ok AS (SELECT en.manifest, en.table_name, min(coalesce(len(s.rows) = row_count, false)::INT) AS good FROM en LEFT JOIN {SEGMENTS} s USING (segment) GROUP BY 1, 2),
  seq AS MATERIALIZED (SELECT workspace, t.name AS table_name, m.manifest, version, row_number() OVER (PARTITION BY workspace, t.name ORDER BY taken_at, m.manifest) AS n FROM m CROSS JOIN tracked_tables t LEFT JOIN ok ON ok.manifest = m.manifest AND ok.table_name = t.name WHERE coalesce(good, 1) = 1),
  v AS (SELECT segment, "at", op, pk, {_VALUE} AS val FROM {KEYED} WHERE pk IS NOT NULL),
  st AS MATERIALIZED (SELECT q.workspace, q.table_name, q.n, v.pk, arg_max(v.op, row(en.pos, v."at")) AS op, arg_max(v.val, row(en.pos, v."at")) AS val FROM seq q JOIN en ON en.manifest = q.manifest AND en.table_name = q.table_name JOIN v ON v.segment = en.segment GROUP BY 1, 2, 3, 4),
  live AS (SELECT * FROM st WHERE op <> 'delete'), pairs AS (SELECT b.workspace, b.table_name, b.n, b.manifest FROM seq a JOIN seq b ON a.workspace = b.workspace AND a.table_name = b.table_name AND a.n + 1 = b.n AND a.version = b.version),
  o AS (SELECT p.*, l.pk, l.val FROM pairs p JOIN live l ON l.workspace = p.workspace AND l.table_name = p.table_name AND l.n = p.n - 1), w AS (SELECT p.*, l.pk, l.val FROM pairs p JOIN live l ON l.workspace = p.workspace AND l.table_name = p.table_name AND l.n = p.n)
  SELECT coalesce(w.workspace, o.workspace) AS workspace, coalesce(w.table_name, o.table_name) AS table_name, coalesce(w.pk, o.pk) AS pk, coalesce(w.manifest, o.manifest) AS manifest, CASE WHEN o.pk IS NULL THEN 'added' WHEN w.pk IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM o FULL JOIN w ON o.workspace = w.workspace AND o.table_name = w.table_name AND o.n = w.n AND o.pk = w.pk WHERE o.pk IS NULL OR w.pk IS NULL OR o.val <> w.val"""

P5_ROWS = f"""(SELECT t AS table_name, version, body FROM (SELECT t, version, CASE WHEN op IS NULL THEN coalesce(CASE WHEN json_exists(j, '$.row') THEN lower(j->>'$.op') END, 'insert') ELSE op END AS op, CASE WHEN json_exists(j, '$.row') AND json_exists(j, '$.op') THEN j->'$.row' ELSE j END AS body FROM
  (SELECT {RESOLVED} AS t, regexp_replace({clean('schema_version')}, '^v', '') AS version, {clean('op')} AS op, CASE WHEN json_valid(row) THEN row::JSON END AS j FROM change_events
   UNION ALL SELECT table_name, regexp_replace({clean('schema_version')}, '^v', ''), NULL, unnest(rows)::JSON FROM segments)) WHERE t IS NOT NULL AND op IN ('insert', 'update') AND json_type(body) = 'OBJECT')"""
_KIND = "CASE json_type(body, '$.' || f) WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN NULL ELSE 'number' END"
P5_LAYOUTS = f"""WITH r AS (SELECT * FROM {P5_ROWS}), c AS (SELECT table_name, version, f AS field, {_KIND} AS kind, count(*) AS n FROM (SELECT table_name, version, body, unnest(json_keys(body)) AS f FROM r) GROUP BY 1, 2, 3, 4),
  k AS (SELECT table_name, version, field, sum(n) AS n, arg_max(kind, n) FILTER (kind IS NOT NULL) AS kind FROM c GROUP BY 1, 2, 3) SELECT k.table_name, k.version, field, kind, k.n::BIGINT AS n FROM k JOIN (SELECT table_name, version, count(*) AS total FROM r GROUP BY 1, 2) USING (table_name, version) WHERE k.n >= 0.1 * total"""

_PK = "regexp_replace(CASE table_name WHEN 'agent.facts' THEN body->>'$.fact_id' WHEN 'public.checkpoints' THEN body->>'$.checkpoint_id' ELSE body->>'$.id' END, '\\.0+$', '')"
_SEQ_ROWS = P5_ROWS.replace("SELECT t AS table_name, version, body FROM", "SELECT t AS table_name, version, body, seq FROM").replace("SELECT t, version, CASE WHEN op IS NULL", "SELECT t, version, seq, CASE WHEN op IS NULL").replace("AS j FROM change_events", "AS j, event_no::DOUBLE AS seq FROM change_events").replace("unnest(rows)::JSON FROM segments", "unnest(rows)::JSON, epoch_us(sealed_at)::DOUBLE FROM segments")
_VAL = "CASE WHEN json_type(body, '$.' || f) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN (body->>('$.' || f))::DOUBLE::VARCHAR ELSE (body->('$.' || f))::VARCHAR END"
P5 = f"""WITH r AS MATERIALIZED (SELECT *, {_PK} AS pk FROM {_SEQ_ROWS}), lay AS MATERIALIZED ({P5_LAYOUTS.replace(f"r AS (SELECT * FROM {P5_ROWS}), ", "")}),
  ord AS (SELECT name AS version, lag(name) OVER (ORDER BY id) AS before FROM (SELECT '0.0.0' AS name, -1 AS id UNION ALL SELECT regexp_replace(lower(trim(name)), '^v', ''), id FROM agentic_migrations)),
  st AS (SELECT DISTINCT a.table_name, o.version, o.before FROM ord o JOIN lay a ON a.version = o.version JOIN lay b ON b.version = o.before AND b.table_name = a.table_name),
  gone AS (SELECT st.*, l.field FROM st JOIN lay l ON l.table_name = st.table_name AND l.version = st.before ANTI JOIN lay n ON n.table_name = st.table_name AND n.version = st.version AND n.field = l.field),
  come AS (SELECT st.*, l.field FROM st JOIN lay l ON l.table_name = st.table_name AND l.version = st.version ANTI JOIN lay o ON o.table_name = st.table_name AND o.version = st.before AND o.field = l.field),
  pairs AS MATERIALIZED (SELECT g.table_name, g.version, g.before, g.field AS old, c.field AS new FROM gone g JOIN come c USING (table_name, version)),
  a AS (SELECT table_name, version, f AS field, pk, arg_max({_VAL}, seq) AS v FROM (SELECT DISTINCT r.*, p.old AS f FROM r JOIN pairs p ON p.table_name = r.table_name AND p.before = r.version) WHERE pk <> '' AND json_type(body, '$.' || f) <> 'NULL' GROUP BY 1, 2, 3, 4),
  b AS (SELECT table_name, version, f AS field, pk, arg_min({_VAL}, seq) AS v FROM (SELECT DISTINCT r.*, p.new AS f FROM r JOIN pairs p ON p.table_name = r.table_name AND p.version = r.version) WHERE pk <> '' AND json_type(body, '$.' || f) <> 'NULL' GROUP BY 1, 2, 3, 4),
  rate AS (SELECT p.table_name, p.version, p.old, p.new, avg((a.v = b.v)::INT) AS rate, count(*) AS n FROM pairs p JOIN a ON a.table_name = p.table_name AND a.version = p.before AND a.field = p.old JOIN b ON b.table_name = p.table_name AND b.version = p.version AND b.field = p.new AND b.pk = a.pk GROUP BY 1, 2, 3, 4),
  pa AS (SELECT table_name, version, field, v, count(*) / sum(count(*)) OVER (PARTITION BY table_name, version, field) AS p FROM a GROUP BY 1, 2, 3, 4), pb AS (SELECT table_name, version, field, v, count(*) / sum(count(*)) OVER (PARTITION BY table_name, version, field) AS p FROM b GROUP BY 1, 2, 3, 4),
  chance AS (SELECT p.table_name, p.version, p.old, p.new, sum(pa.p * pb.p) AS chance FROM pairs p JOIN pa ON pa.table_name = p.table_name AND pa.version = p.before AND pa.field = p.old JOIN pb ON pb.table_name = p.table_name AND pb.version = p.version AND pb.field = p.new AND pb.v = pa.v GROUP BY 1, 2, 3, 4),
  ren AS (SELECT * FROM (SELECT rate.*, row_number() OVER (PARTITION BY table_name, version, old ORDER BY rate DESC, n DESC, old, new) AS i, row_number() OVER (PARTITION BY table_name, version, new ORDER BY rate DESC, n DESC, old, new) AS j FROM rate LEFT JOIN chance USING (table_name, version, old, new) WHERE rate >= 0.5 AND rate - coalesce(chance, 0) >= 0.25) WHERE i = 1 AND j = 1)
  SELECT table_name, version AS schema_version, 'renamed' AS change, old AS field, new AS new_field FROM ren
  UNION ALL SELECT g.table_name, g.version, 'removed', g.field, '' FROM gone g ANTI JOIN ren ON ren.table_name = g.table_name AND ren.version = g.version AND ren.old = g.field
  UNION ALL SELECT c.table_name, c.version, 'added', c.field, '' FROM come c ANTI JOIN ren ON ren.table_name = c.table_name AND ren.version = c.version AND ren.new = c.field
  UNION ALL SELECT st.table_name, st.version, 'retyped', n.field, '' FROM st JOIN lay n ON n.table_name = st.table_name AND n.version = st.version JOIN lay o ON o.table_name = st.table_name AND o.version = st.before AND o.field = n.field WHERE n.kind <> o.kind"""

_LINKS = f"(SELECT c.commit_hash, p.commit_hash AS parent FROM {COMMITS} c LEFT JOIN {COMMITS} p ON p.commit_hash = c.parent)"
_TREE = f"l AS MATERIALIZED (SELECT * FROM {_LINKS}), t AS (SELECT commit_hash, commit_hash AS root, 0::BIGINT AS depth, commit_hash AS path FROM l WHERE parent IS NULL UNION ALL SELECT l.commit_hash, t.root, t.depth + 1, t.path || '/' || l.commit_hash FROM t JOIN l ON l.parent = t.commit_hash)"
_CYCLE = "up AS (SELECT commit_hash AS start, parent AS node FROM rest WHERE parent IS NOT NULL UNION SELECT up.start, rest.parent FROM up JOIN rest ON rest.commit_hash = up.node WHERE rest.parent IS NOT NULL)"
P6 = f"""WITH RECURSIVE {_TREE}, rest AS MATERIALIZED (SELECT * FROM l WHERE commit_hash NOT IN (SELECT commit_hash FROM t)), {_CYCLE}
  SELECT commit_hash, root, depth, 'tree' AS state FROM t UNION ALL SELECT commit_hash, '', -1, CASE WHEN commit_hash IN (SELECT start FROM up WHERE start = node) THEN 'in_cycle' ELSE 'under_cycle' END FROM rest"""
P6_PATHS = f"""WITH RECURSIVE {_TREE}, rest AS MATERIALIZED (SELECT * FROM l WHERE commit_hash NOT IN (SELECT commit_hash FROM t)), {_CYCLE}
  SELECT commit_hash, path, depth, 'tree' AS state FROM t UNION ALL SELECT commit_hash, NULL, -1, CASE WHEN commit_hash IN (SELECT start FROM up WHERE start = node) THEN 'in_cycle' ELSE 'under_cycle' END FROM rest"""
P6_DESCENDANTS = f"""WITH RECURSIVE {_TREE}, a AS (SELECT commit_hash, path, depth, unnest(string_split(path, '/')) AS above, generate_subscripts(string_split(path, '/'), 1) - 1 AS level FROM t)
  SELECT above AS commit_hash, commit_hash AS descendant, depth - level AS distance FROM a WHERE above <> commit_hash"""

P6_SIZES = f"SELECT c.commit_hash, 1 + count(d.descendant) AS size FROM {COMMITS} c LEFT JOIN ({P6_DESCENDANTS}) d ON d.commit_hash = c.commit_hash WHERE c.commit_hash IN (SELECT commit_hash FROM ({P6}) WHERE state = 'tree') GROUP BY 1"

#: P4 with the places of the elements that decide, and their text as stored (of repeated segments the greatest).
_RAW = f"""raw AS MATERIALIZED (SELECT segment, "at", max(value) AS value FROM (SELECT {norm('segment')} AS segment, unnest(generate_series(0, len(rows) - 1)) AS "at", unnest(rows) AS value FROM segments) GROUP BY 1, 2)"""
P4_VALUES = (
    P4.replace("WITH m AS", f"WITH {_RAW}, m AS", 1)
    .replace('arg_max(v.val, row(en.pos, v."at")) AS val FROM', 'arg_max(v.val, row(en.pos, v."at")) AS val, arg_max(row(v.segment, v."at"), row(en.pos, v."at")) AS place FROM')
    .replace("b.n, b.manifest FROM seq a", "b.n, b.manifest, a.manifest AS manifest_before FROM seq a")
    .replace("l.pk, l.val FROM pairs p", "l.pk, l.val, l.place FROM pairs p")
    .replace("coalesce(w.manifest, o.manifest) AS manifest,", "coalesce(w.manifest, o.manifest) AS manifest, coalesce(w.manifest_before, o.manifest_before) AS manifest_before, (SELECT value FROM raw WHERE raw.segment = o.place[1] AND raw.\"at\" = o.place[2]) AS old_row, (SELECT value FROM raw WHERE raw.segment = w.place[1] AND raw.\"at\" = w.place[2]) AS new_row,")
)

SQL = {"p1_found": P1, "p2_found": P2, "p2_report": P2_REPORT, "p4_found": P4, "p5_found": P5, "p5_layouts": P5_LAYOUTS, "p6_found": P6, "p6_paths": P6_PATHS, "p6_descendants": P6_DESCENDANTS, "p6_sizes": P6_SIZES, "p4_values": P4_VALUES}
