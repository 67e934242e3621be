"""Tracked tables: names, keys and how a change finds its table."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Configuration, not data: more tracked tables than this is refused instead of collected.
MAX_TRACKED = 10_000


@dataclass(frozen=True)
class Tracked:
    name: str
    pk: str


def tracked_list(df: DataFrame) -> list[Tracked]:
    """Tracked tables as configuration; rows without a name or key column are skipped, repeats count once."""
    rows = df.select("name", "pk").where("name is not null and pk is not null").distinct().limit(MAX_TRACKED + 1).collect()
    if len(rows) > MAX_TRACKED:
        raise ValueError(f"more than {MAX_TRACKED} tracked tables")
    return sorted((Tracked(r.name, r.pk) for r in rows), key=lambda t: (t.name, t.pk))


def normal_name(c: Column) -> Column:
    """Lower case, without blanks around and double quotes."""
    return F.lower(F.regexp_replace(F.trim(c), r'"', ""))


def bare_name(c: Column) -> Column:
    return F.element_at(F.split(c, r"\."), -1)


def resolver(tracked: list[Tracked]) -> dict[str, str]:
    """Normal spelling -> tracked name. A bare name counts only if one tracked table has it; no schema means public."""
    full: dict[str, str] = {}
    bare = Counter(t.name.replace('"', "").lower().split(".")[-1] for t in tracked)
    for t in tracked:
        n = t.name.replace('"', "").strip().lower()
        full[n if "." in n else f"public.{n}"] = t.name
    return full | {k: v for t in tracked for k, v in [(t.name.replace('"', "").lower().split(".")[-1], t.name)] if bare[k] == 1 and k not in full}


def resolve(c: Column, tracked: list[Tracked]) -> Column:
    """The tracked table that a spelling names, else null."""
    known = resolver(tracked)
    if not known:
        return F.lit(None).cast("string")
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(pairs, normal_name(c))
