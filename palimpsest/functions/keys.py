"""Keys and references: plain spelling, JSON access by Variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import Tracked
from .once import once

NUMBER = r"^[+-]?([0-9]+)(\.[0-9]*)?([eE][+-]?[0-9]{1,3})?$"


def reference(c: Column) -> Column:
    """Hashes compare without regard to case and surrounding white space; an empty one is none."""
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(c != "", c)


def plain_key(c: Column) -> Column:
    """The plain text of a key: digits for integers however spelled (7, 7.0, 7e0, "7"), other text as it is, blank as null."""
    t = F.trim(c)
    integer = t.rlike(r"^-?(0|[1-9][0-9]*)$")
    n = t.try_cast("decimal(38,12)")
    text = F.regexp_replace(F.regexp_replace(n.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(t == "", F.lit(None)).when(integer, t).when(t.rlike(NUMBER) & n.isNotNull(), text).otherwise(c)


def is_object(v: Column, path: str = "$") -> Column:
    """Whether a Variant is an object (false for null). Cheaper than its schema, which would be worked out at every depth."""
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def is_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>").isNotNull()


def body(v: Column) -> Column:
    """The row inside its envelope {"op":…,"row":{…}}, or the object itself."""
    return F.when(is_object(v, "$.row") & F.try_variant_get(v, "$.op", "string").isNotNull(), F.try_variant_get(v, "$.row", "variant")).otherwise(v)


def field(v: Column, name: str) -> Column:
    """A scalar field of a Variant object as text; objects and arrays are no keys."""
    path = "$['" + name.replace("'", "\\'") + "']"
    return F.when(~is_object(v, path) & ~is_array(v, path), F.try_variant_get(v, path, "string"))


def with_key(df: DataFrame, tracked: list[Tracked], v: str = "v", table: str = "table_name", pk: str = "pk") -> DataFrame:
    """df with `pk`: the plain key of the parsed row `v` by its table's key column; null where null, absent or unreadable."""
    out = F.lit(None).cast("string")
    for t in tracked:
        out = F.when(F.col(table) == t.name, field(F.col(v), t.pk)).otherwise(out)
    df = once(df, _key=out)
    return once(df, **{pk: plain_key(F.col("_key"))}).drop("_key")


def with_body(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `v0`, the parsed JSON (null if it does not parse), and `v`, the row inside its envelope."""
    return once(once(df, v0=F.try_parse_json(text)), v=body(F.col("v0")))
