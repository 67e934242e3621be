"""Problem 5: fields that drift between versions; one union schema, one table, ordered differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import is_array, is_object, with_body, with_key
from ..functions.names import Tracked, resolve
from ..functions.once import once
from ..session import cut

#: Least share of a version's rows that carry a field of that version.
LEAST_SHARE = 0.1
#: A renamed field agrees on at least this share of common keys, and by this much more than unrelated pairs would, or by
#: the first share of what is left above chance, where that is less.
LEAST_AGREEMENT, LEAST_LIFT = 0.5, 0.25
#: In the latter case the agreement is also this many standard deviations above chance.
LEAST_DEVIATIONS = 3
#: Most typed columns of a consistent table; fields beyond the most frequent ones are held as JSON.
MOST_FIELDS = 1_000
#: Kinds of the type-promotion lattice, see joined().
LATTICE = ("boolean", "number", "text", "array", "object")


def version_of(c: Column) -> Column:
    """Versions read without blanks and a leading v."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"^v\s*", "")


def kind_of(v: Column) -> Column:
    """number, text, boolean, array or object; null for null."""
    s = F.schema_of_variant(v)  # of scalars only
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(None)).when(is_object(v), "object").when(is_array(v), "array")
        .when(s.startswith("STRING"), "text").when(s == "BOOLEAN", "boolean").otherwise("number")
    )


def versioned_rows(events: DataFrame, segments: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """Inserted and updated rows of both feeds as (table_name, version, seq, v); v is the row as Variant.

    Rows that do not parse to an object, unknown tables and deletes are left out; seq orders rows within a version.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    a = events.select(resolve(F.col("table_name"), tracked).alias("table_name"), version_of(F.col("schema_version")).alias("version"), clean(F.col("op")).alias("op"), F.col("event_no").cast("double").alias("seq"), F.col("row").alias("text"))
    b = segments.select(resolve(F.col("table_name"), tracked).alias("table_name"), version_of(F.col("schema_version")).alias("version"), F.lit(None).cast("string").alias("op"), F.unix_micros(F.col("sealed_at").cast("timestamp")).cast("double").alias("seq"), F.explode("rows").alias("text"))
    both = a.unionByName(b).where("table_name is not null and version is not null")
    op = F.coalesce(F.when(F.col("op").isNull(), clean(F.try_variant_get("v0", "$.op", "string"))), F.col("op"), F.lit("insert"))
    rows = once(with_body(both), keep=op.isin("insert", "update") & is_object(F.col("v"))).where("keep")
    return rows.select("table_name", "version", "seq", "v")


def keyed(rows: DataFrame, tracked: list[Tracked]) -> DataFrame:
    """versioned_rows() with the plain key `pk` of each row, null where it has none."""
    return with_key(rows, tracked)


def fields_of(rows: DataFrame) -> DataFrame:
    """One row per row and field: the row's columns but v, (pos, field, value); an empty row once with nulls."""
    kept = [c for c in rows.columns if c != "v"]
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select(*kept, "pos", F.col("key").alias("field"), "value")


def counted(rows: DataFrame) -> DataFrame:
    """(table_name, version, field, kind, n, rows): all fields and kinds of the rows, however rare; the sum of `rows` is that of the version's rows."""
    cells = fields_of(rows).select("table_name", "version", "field", kind_of(F.col("value")).alias("kind"), F.coalesce(F.col("pos") == 0, F.lit(True)).alias("first"))
    # each row has one first field, so one pass counts rows as well
    return cut(cells.groupBy("table_name", "version", "field", "kind").agg(F.count("*").alias("n"), F.count_if("first").alias("rows")))


def layouts(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(table_name, version, field, share, kind, holds, n): the fields of each version.

    The layouts of the files' rows are read in parallel and folded map-side into counts per kind. A field belongs to a
    version when at least a tenth of the version's rows carry it, null or not; its kind is that of most non-null values
    (ties: the wider one in the lattice), `holds` the least that holds all of them. So at most ten times a row's width remain per version: a bounded result.
    counts: counted(rows), where it is there already.
    """
    counts = counted(rows) if counts is None else counts
    total = counts.groupBy("table_name", "version").agg(F.sum("rows").alias("rows"))
    wide = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(LATTICE)])
    each = counts.groupBy("table_name", "version", "field").agg(F.sum("n").alias("n"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", wide.alias("w"), "kind"))).alias("m"), joined(F.col("kind")).alias("holds"))
    return each.where("field is not null").join(total, ["table_name", "version"]).where(F.col("n") >= LEAST_SHARE * F.col("rows")).select("table_name", "version", "field", (F.col("n") / F.col("rows")).alias("share"), F.col("m.kind").alias("kind"), "holds", "n")


def versions_in_order(migrations: DataFrame) -> DataFrame:
    """(version, ordinal, before): 0.0.0 first, then migrations by id."""
    named = migrations.select(version_of(F.col("name")).alias("version"), "id").where("version is not null and id is not null").groupBy("version").agg(F.min("id").alias("id"))
    spark = migrations.sparkSession
    allv = spark.createDataFrame([("0.0.0", None)], "version string, id int").unionByName(named.where("version <> '0.0.0'"))
    w = W.orderBy(F.col("id").asc_nulls_first())  # one row per migration
    return allv.select("version", F.row_number().over(w).alias("ordinal"), F.lag("version").over(w).alias("before"))


def value_text(v: Column) -> Column:
    """A value spelled one way: numbers as double, else JSON."""
    return F.when(kind_of(v) == "number", F.try_variant_get(v, "$", "double").cast("string")).otherwise(F.to_json(v))


def renames(rows: DataFrame, tracked: list[Tracked], gone: DataFrame, come: DataFrame) -> DataFrame:
    """(table_name, version, field, new_field): pairs of a removed and an added field whose values stay the same for the same keys.

    gone: (table_name, version, before, field); come: (table_name, version, field). Values are compared at the border of
    the versions: the last value before, the first after. Each field takes part in one rename, the best agreeing. Where most
    values are equal anyhow, agreement counts relative to what chance leaves; for that, about five keys have rarer values.
    """
    pairs = cut(gone.withColumnRenamed("field", "old").join(come.withColumnRenamed("field", "new"), ["table_name", "version"]))
    # layouts at such a border; a literal condition, since that reaches the scan before rows are parsed
    border = {v for r in pairs.select("table_name", "version", "before").distinct().collect() for v in ((r.table_name, r.version), (r.table_name, r.before))}
    at_border = F.concat_ws("\n", "table_name", "version").isin([f"{t}\n{v}" for t, v in sorted(border)])
    wanted = pairs.select("table_name", F.col("before").alias("version"), F.col("old").alias("field"), F.lit(True).alias("last")).unionByName(pairs.select("table_name", "version", F.col("new").alias("field"), F.lit(False).alias("last"))).distinct()
    cells = fields_of(keyed(rows.where(at_border), tracked).where("pk is not null")).where("not is_variant_null(value)").join(F.broadcast(wanted), ["table_name", "version", "field"])  # wanted: bounded by layouts()
    border = cells.withColumn("value", value_text(F.col("value"))).groupBy("table_name", "version", "field", "pk", "last").agg(F.max(F.when(F.col("last"), F.struct("seq", "value"))).alias("b"), F.min(F.when(~F.col("last"), F.struct("seq", "value"))).alias("a"))
    border = cut(border.select("table_name", "version", "field", "pk", F.coalesce("b.value", "a.value").alias("value"), "last"))
    left = border.where("last").join(F.broadcast(pairs.select("table_name", F.col("before").alias("version"), F.col("version").alias("next"), F.col("old").alias("field"), "new")), ["table_name", "version", "field"])
    right = border.where("not last").select("table_name", F.col("version").alias("next"), F.col("field").alias("new"), "pk", F.col("value").alias("value2"))
    met = left.join(right, ["table_name", "next", "new", "pk"])
    rate = met.groupBy("table_name", F.col("next").alias("version"), F.col("field").alias("old"), "new").agg(F.avg((F.col("value") == F.col("value2")).cast("double")).alias("rate"), F.count("*").alias("keys"))
    # chance: how often values of unrelated keys would agree
    share = border.groupBy("table_name", "version", "field", "value").agg(F.count("*").alias("n"))
    total = F.broadcast(share.groupBy("table_name", "version", "field").agg(F.sum("n").alias("total")))  # one row per candidate field
    share = share.join(total, ["table_name", "version", "field"]).withColumn("p", F.col("n") / F.col("total"))
    p = share.select("table_name", F.col("version").alias("before"), F.col("field").alias("old"), "value", "p")
    q = share.select("table_name", "version", F.col("field").alias("new"), "value", F.col("p").alias("q"))
    chance = pairs.join(p, ["table_name", "before", "old"]).join(q, ["table_name", "version", "new", "value"]).groupBy("table_name", "version", "old", "new").agg(F.sum(F.col("p") * F.col("q")).alias("chance"))
    chance_of = F.coalesce("chance", F.lit(0.0))
    lift, left_above = F.col("rate") - chance_of, F.lit(1.0) - chance_of
    beyond = (left_above > 1e-9) & (lift >= LEAST_AGREEMENT * left_above) & (lift * F.sqrt("keys") >= LEAST_DEVIATIONS * F.sqrt(chance_of * F.greatest(left_above, F.lit(0.0))))
    good = rate.join(chance, ["table_name", "version", "old", "new"], "left").where((F.col("rate") >= LEAST_AGREEMENT) & ((lift >= LEAST_LIFT) | beyond))
    best = lambda c: F.row_number().over(W.partitionBy("table_name", "version", c).orderBy(F.desc("rate"), F.desc("keys"), "old", "new"))
    return good.withColumn("i", best("old")).withColumn("j", best("new")).where("i = 1 and j = 1").select("table_name", "version", F.col("old").alias("field"), F.col("new").alias("new_field"))


def layout_changes(rows: DataFrame, migrations: DataFrame, tracked: list[Tracked], counts: DataFrame | None = None) -> DataFrame:
    """(table_name, schema_version, change, field, new_field): each version of each table against the one before.

    Versions no migration brings are not compared. Where a table has no rows under a version, that version has no layout:
    nothing is reported between it and its neighbours.
    """
    have = cut(layouts(rows, counts))
    order = versions_in_order(migrations)
    there = have.select("table_name", "version").distinct()
    steps = F.broadcast(there.join(order.where("before is not null"), "version").join(there.withColumnRenamed("version", "before"), ["table_name", "before"]))
    new = have.select("table_name", "version", "field", "kind").join(steps, ["table_name", "version"])
    old = have.select("table_name", F.col("version").alias("before"), "field", F.col("kind").alias("kind0")).join(steps, ["table_name", "before"])
    both = cut(old.join(new.select("table_name", "version", "field", "kind", F.lit(True).alias("is_new")), ["table_name", "version", "field"], "full").join(steps.select("table_name", "version", F.col("before").alias("prior")), ["table_name", "version"]).withColumn("was_old", F.col("before").isNotNull()))
    gone = both.where("is_new is null").select("table_name", "version", F.col("prior").alias("before"), "field")
    come = both.where("not was_old").select("table_name", "version", "field")
    renamed = cut(renames(rows, tracked, gone, come))
    out = lambda df, change, new_field=F.lit(""): df.select("table_name", F.col("version").alias("schema_version"), F.lit(change).alias("change"), "field", new_field.alias("new_field"))
    left = gone.join(renamed.select("table_name", "version", "field"), ["table_name", "version", "field"], "left_anti")
    fresh = come.join(renamed.select("table_name", "version", F.col("new_field").alias("field")), ["table_name", "version", "field"], "left_anti")
    retyped = both.where("was_old and is_new and kind is not null and kind0 is not null and kind <> kind0")
    return out(fresh, "added").unionByName(out(left, "removed")).unionByName(out(retyped, "retyped")).unionByName(out(renamed, "renamed", F.col("new_field")))


def joined(kinds: Column) -> Column:
    """Aggregate: the least kind that holds all kinds of a group. The lattice: boolean < number < text; array and object meet anything else in text (as JSON).

    Kinds fold as bits, so tasks combine what they have seen of a field and the fold is associative and in any order.
    """
    bits = F.bit_or(F.coalesce(*[F.when(kinds == k, F.lit(1 << i)) for i, k in enumerate(LATTICE)]))
    single = F.coalesce(*[F.when(bits == 1 << i, F.lit(k)) for i, k in enumerate(LATTICE)])
    return F.coalesce(single, F.when(bits == 3, "number"), F.lit("text"))


def union_schema(have: DataFrame, changes: DataFrame, table: str) -> list[tuple[str, str, list[str]]]:
    """[(field, kind, names)] of one table: names it had, newest first, and the least kind that holds them all.

    have: counted(), so that fields and kinds of any share count. Bounded by MOST_FIELDS; of columns that differ in letter
    case alone, the most frequent is taken. What is left out goes to unified()'s rest.
    """
    seen = have.where((F.col("table_name") == table) & F.col("field").isNotNull()).groupBy("field").agg(joined(F.col("kind")).alias("kind"), F.sum("n").alias("n"), F.count("kind").alias("typed"))
    later = {r.field: r.new_field for r in changes.where((F.col("table_name") == table) & (F.col("change") == "renamed")).collect()}
    out, taken = {}, {}
    for r in seen.orderBy(F.desc("n"), "field").limit(MOST_FIELDS).collect():
        head, passed = r.field, {r.field}
        while head in later and later[head] not in passed:
            head = later[head]
            passed.add(head)
        if taken.setdefault(head.lower(), head) != head:
            continue
        names, ks = out.setdefault(head, ([], set()))
        names.append(r.field)
        ks |= {r.kind} if r.typed else set()
    over = lambda ks: next(iter(ks)) if len(ks) == 1 else "number" if ks and ks <= {"boolean", "number"} else "text"  # noqa: E731 - joined() over the names of a renamed field
    return [(f, over(ks), sorted(names, key=lambda n: (n != f, n))) for f, (names, ks) in sorted(out.items())]


def unified(rows: DataFrame, schema: list[tuple[str, str, list[str]]], table: str, rest: bool = False) -> DataFrame:
    """All rows (keyed()) of one table under its union schema: version, pk, then one typed column per field (arrays and objects as JSON).

    With rest, a last column `rest` holds as JSON what the typed columns do not: fields outside the schema, and the value
    under an older name where the row has another one under a newer name. Null where there is nothing.
    """
    rows = once(rows.where(F.col("table_name") == table), fields=F.try_variant_get("v", "$", "map<string,variant>"))  # no path, so that fields may have any name
    value = lambda n: F.col("fields")[F.lit(n)]
    at = lambda n, kind: F.try_variant_get(value(n), "$", kind)
    num = lambda n: F.coalesce(at(n, "double"), at(n, "boolean").cast("double"), at(n, "string").try_cast("double"))
    text = lambda n: F.coalesce(at(n, "string"), F.when(kind_of(value(n)).isNotNull(), F.to_json(value(n))))
    get = {"number": num, "boolean": lambda n: at(n, "boolean"), "text": text, "array": text, "object": text}
    columns = [F.coalesce(*[get[kind](n) for n in names]).alias(f"f_{f}") for f, kind, names in schema]
    if rest:
        held = [n for _, _, names in schema for n in names]
        hidden = [F.when(get[kind](n) != F.coalesce(*[get[kind](m) for m in names[:i]]), F.lit(n)) for _, kind, names in schema for i, n in enumerate(names) if i]
        other = F.map_filter("fields", lambda k, _: ~k.isin(held) | (F.array_contains(F.array_compact(F.array(*hidden)), k) if hidden else F.lit(False)))
        columns.append(F.when(F.size(other) > 0, F.to_json(other)).alias("rest"))
    return rows.select("version", "pk", *columns)
