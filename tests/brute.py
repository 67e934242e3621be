"""Plain-Python versions of the operators, written from the statements of the problems, for comparison on small inputs."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

import pyarrow.parquet as pq


def rows(d: str, name: str) -> list[dict]:
    return pq.read_table(f"{d}/{name}.parquet").to_pylist()


def norm(x: str | None) -> str | None:
    return (x or "").strip().lower() or None


def load(text):
    try:
        x = json.loads(text)
    except (TypeError, ValueError):
        return None
    return x if isinstance(x, dict) else None


def key(x) -> str | None:
    if x is None or isinstance(x, (dict, list)):
        return None
    if isinstance(x, bool):
        return str(x).lower()
    s = str(x)
    if not s.strip():
        return None
    try:
        n = Decimal(s.strip())
        return str(int(n)) if n.is_finite() and n == int(n) else s
    except (InvalidOperation, OverflowError):
        return s


def table_of(name, tracked):
    n = (name or "").strip().replace('"', "").lower()
    for t in tracked:
        full = t if "." in t else f"public.{t}"
        if n in (full, full.split(".")[-1]):
            return t


def p1(d):
    pk = {r["name"]: r["pk"] for r in rows(d, "tracked_tables")}
    last = {}
    for r in sorted(rows(d, "agentic_change_log"), key=lambda r: r["id"]):
        op, t, x = (r["op"] or "").strip().lower(), table_of(r["table_name"], pk), load(r["row"])
        if op not in ("insert", "update", "delete") or t is None or x is None:
            continue
        if isinstance(x.get("row"), dict) and "op" in x:
            x = x["row"]
        k = key(x.get(pk[t]))
        if k is not None:
            last[t, k] = (r["id"], op)
    return {(t, k, i) for (t, k), (i, op) in last.items() if op != "delete"}


def p2(d):
    commits, manifests, segments = rows(d, "commits"), rows(d, "segment_manifests"), rows(d, "segments")

    def target(rs, k, t):
        out = {}
        for r in rs:
            h = norm(r[k])
            a = out.setdefault(h, [r[t], None])
            a[0] = min(a[0], r[t])
            a[1] = a[1] or r.get("reclaimed_at")
        return out

    tc, tm, ts = target(commits, "commit_hash", "committed_at"), target(manifests, "manifest", "stored_at"), target(segments, "segment", "stored_at")
    for v in tc.values():
        v[1] = None
    out = set()

    def see(table, field, rec, key, at, tgt):
        key = norm(key)
        if key is None:
            return
        kind = "missing" if key not in tgt else "deleted" if tgt[key][1] else "late" if tgt[key][0] > at else None
        if kind:
            out.add((table, field, norm(rec), key, kind, at.strftime("%Y-%m")))

    for r in commits:
        see("commits", "parent", r["commit_hash"], r["parent"], r["committed_at"], tc)
        see("commits", "memory_snapshot", r["commit_hash"], r["memory_snapshot"], r["committed_at"], tm)
    for r in manifests:
        for e in r["entries"]:
            see("segment_manifests", "segment", r["manifest"], e["segment"], r["taken_at"], ts)
    return out


def same(x):
    if isinstance(x, dict):
        return tuple(sorted((k, same(v)) for k, v in x.items() if v is not None))
    if isinstance(x, list):
        return ("list", *map(same, x))
    return (type(x).__name__ if isinstance(x, (str, bool)) else "n", x)


def p4(d):
    pk = {r["name"]: r["pk"] for r in rows(d, "tracked_tables")}
    segs = {}
    for r in rows(d, "segments"):
        h = norm(r["segment"])
        if r["rows"] is not None and (h not in segs or len(segs[h]) < len(r["rows"])):
            segs[h] = r["rows"]
    ms = {norm(r["manifest"]): r for r in sorted(rows(d, "segment_manifests"), key=lambda r: r["stored_at"], reverse=True)}
    last, out = {}, set()
    for h, m in sorted(ms.items(), key=lambda x: (x[1]["taken_at"], x[0])):
        for t in pk:
            es = [e for e in m["entries"] if table_of(e["table_name"], pk) == t]
            if not all(len(segs.get(norm(e["segment"]), ())) == e["row_count"] and norm(e["segment"]) in segs for e in es):
                continue
            state = {}
            for e in es:
                for text in segs[norm(e["segment"])]:
                    x = load(text)
                    if x is None:
                        continue
                    op, row = (x["op"].strip().lower(), x["row"]) if isinstance(x.get("row"), dict) and "op" in x else ("insert", x)
                    k = key(row.pop(pk[t], None))
                    if op == "delete":
                        state.pop(k, None)
                    elif k is not None:
                        state[k] = same(row)
            old = last.get((m["workspace"], t))
            last[m["workspace"], t] = (m["schema_version"], state)
            if old and old[0] == m["schema_version"]:
                for k in state.keys() | old[1].keys():
                    c = "added" if k not in old[1] else "removed" if k not in state else "changed" if state[k] != old[1][k] else None
                    if c:
                        out.add((m["workspace"], t, k, h, c))
    return out


def p6(links: dict):
    """links: id -> parent or None; parents that are not stored count as none."""
    out = {}
    for i in links:
        seen, x = [i], i
        while (p := links[x]) in links and p is not None and p not in seen:
            seen.append(p)
            x = p
        if p in links and p is not None:
            out[i] = (i, "", -1, "in_cycle" if p == i else "under_cycle")
        else:
            out[i] = (i, x, len(seen) - 1, "tree")
    return set(out.values())
