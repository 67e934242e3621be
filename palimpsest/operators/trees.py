"""Trees of named contents, their hashes and differences; commits and their dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import reference
from ..functions.scalars import changed, content_hash, merkle

DIMENSIONS = ("code_sha", "prompts", "tools", "model", "memory_snapshot", "schema_version")


def tree_entries(commits: DataFrame, tree: str) -> DataFrame:
    """(commit_hash, name, hash, text) of one tree of each commit, once per commit and name."""
    return (
        commits.select(reference(F.col("commit_hash")).alias("commit_hash"), F.explode(tree).alias("name", "text"))
        .where("commit_hash is not null").groupBy("commit_hash", "name").agg(F.min("text").alias("text")).withColumn("hash", content_hash(F.coalesce("text", F.lit(""))))
    )


def tree_hashes(entries: DataFrame) -> DataFrame:
    """(commit_hash, tree_hash, n): the hash over names and contents, whatever their order."""
    return entries.groupBy("commit_hash").agg(merkle(F.collect_list(F.struct("name", "hash"))).alias("tree_hash"), F.count("*").alias("n"))  # the files of one commit


def diff_entries(old: DataFrame, new: DataFrame, by: list[str], value: str = "hash") -> DataFrame:
    """(…by, change, from, to): keyed full outer comparison; equal values give no row."""
    a, b = old.select(*by, F.col(value).alias("from"), F.lit(True).alias("_a")), new.select(*by, F.col(value).alias("to"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("from").eqNullSafe(F.col("to")), "modified")
    return a.join(b, by, "full").withColumn("change", kind).where("change is not null").select(*by, "change", "from", "to")


def one_each(commits: DataFrame) -> DataFrame:
    """Commits once each, hashes normalised; of repeated rows the earliest holds, one without time last."""
    cols = ["branch", "author", "message", "committed_at", "code_sha", "prompts", "tools", "model", "schema_version", "cost_cents", "peer_uid"]
    c = commits.select(reference(F.col("commit_hash")).alias("commit_hash"), reference(F.col("parent")).alias("parent"), reference(F.col("memory_snapshot")).alias("memory_snapshot"), *cols).where("commit_hash is not null")
    rest = [x for x in c.columns if x != "commit_hash"]
    return c.groupBy("commit_hash").agg(F.min_by(F.struct(*rest), F.coalesce("committed_at", F.lit("9999-12-31").cast("timestamp"))).alias("c")).select("commit_hash", "c.*")


def against_parent(commits: DataFrame) -> DataFrame:
    """(commit_hash, parent) of one_each() whose parent is stored."""
    links = commits.select("commit_hash", "parent").where("parent is not null")
    return links.join(commits.select(F.col("commit_hash").alias("parent")), "parent", "left_semi").select("commit_hash", "parent")


def tree_diffs(commits: DataFrame, tree: str) -> DataFrame:
    """(commit_hash, name, change, from, to): files of every commit against those of its parent."""
    return _tree_diffs(commits, [tree], against_parent(_scalars(commits))).drop("dimension")


def _tree_diffs(commits: DataFrame, trees: list[str], links: DataFrame) -> DataFrame:
    """tree_diffs() of several trees at once, with `dimension`: one comparison for all of them."""
    each = [tree_entries(commits, t).select(F.lit(t).alias("dimension"), "commit_hash", "name", "hash") for t in trees]
    entries = each[0]
    for e in each[1:]:
        entries = entries.unionByName(e)
    old = links.join(entries.withColumnRenamed("commit_hash", "parent"), "parent").drop("parent")
    new = links.select("commit_hash").join(entries, "commit_hash")
    return diff_entries(old, new, ["commit_hash", "dimension", "name"])


def _scalars(commits: DataFrame) -> DataFrame:
    """one_each() without the trees, which are not moved then."""
    none = F.lit(None).cast("map<string,string>")
    return one_each(commits.withColumns({"prompts": none, "tools": none})).drop("prompts", "tools")


def scalar_diffs(commits: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """(commit_hash, dimension, from, to): single-valued dimensions of every commit against its parent."""
    c = _scalars(commits) if c is None else c
    names = ("code_sha", "model", "memory_snapshot", "schema_version")
    old = c.select(F.col("commit_hash").alias("parent"), *[F.col(n).alias(f"{n}_old") for n in names])
    both = c.select("commit_hash", "parent", *names).join(old, "parent")
    each = F.array(*[F.struct(F.lit(n).alias("dimension"), changed(F.col(f"{n}_old"), F.col(n)).alias("c")) for n in names])
    return both.select("commit_hash", F.inline(F.filter(each, lambda x: x.c.isNotNull()))).select("commit_hash", "dimension", "c.from", "c.to")


def commit_diffs(commits: DataFrame) -> DataFrame:
    """(commit_hash, dimension, name, change, from, to): all six dimensions of every commit against its parent."""
    c = _scalars(commits).select("commit_hash", "parent", "code_sha", "model", "memory_snapshot", "schema_version")
    trees = _tree_diffs(commits, ["prompts", "tools"], against_parent(c)).select("commit_hash", "dimension", "name", "change", "from", "to")
    return trees.unionByName(scalar_diffs(commits, c).select("commit_hash", "dimension", F.lit("").alias("name"), F.lit("modified").alias("change"), "from", "to"))


def render(change: Column, name: Column) -> Column:
    """One line of a tree diff: + added, - removed, ~ modified."""
    return F.concat(F.when(change == "added", "+ ").when(change == "removed", "- ").otherwise("~ "), name)


def tuple_hash(commits: DataFrame) -> DataFrame:
    """(commit_hash, tuple_hash): over the six dimensions alone, so equal states have equal hashes whoever committed them.

    Values are joined with their names and a mark for null, so no two tuples give the same text.
    """
    c = one_each(commits)
    for t in ("prompts", "tools"):
        c = c.join(tree_hashes(tree_entries(commits, t)).select("commit_hash", F.col("tree_hash").alias(f"{t}_hash")), "commit_hash", "left")
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(F.concat(F.lit("'"), F.col(col), F.lit("'")), F.lit("null"))) for n, col in (("code_sha", "code_sha"), ("prompts", "prompts_hash"), ("tools", "tools_hash"), ("model", "model"), ("memory_snapshot", "memory_snapshot"), ("schema_version", "schema_version"))]
    return c.select("commit_hash", F.sha2(F.concat_ws("\n", *parts), 256).alias("tuple_hash"))


def file_directory_conflicts(entries: DataFrame, by: str) -> DataFrame:
    """(by, file, inside): a name that is also the directory of another, compared by path components without case.

    Each name gives its own ancestor paths, which meet names by equality: no pairs are formed within a tree.
    """
    path = F.regexp_replace(F.regexp_replace(F.lower("name"), "/+", "/"), r"(/\.)+(/|$)", "$2")
    named = entries.select(by, "name", path.alias("path"))
    parts = F.split("path", "/")
    above = named.withColumn("parts", parts).where(F.size("parts") > 1).select(by, F.col("name").alias("inside"), F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))).alias("path"))
    return named.join(above, [by, "path"]).select(by, F.col("name").alias("file"), "inside")


def captured(old: DataFrame, new: DataFrame, pk: str, table: str) -> DataFrame:
    """(table_name, op, pk, row): the change log that turns `old` into `new`; a delete logs the old row, others the new one, as JSON.

    Rows are compared as JSON text of their typed columns, nulls included. Keys are unique and not null in each state.
    """
    side = [d.select(F.col(pk).alias("pk"), F.to_json(F.struct(*sorted(d.columns)), {"ignoreNullFields": "false"}).alias("row")) for d in (old, new)]
    diff = diff_entries(side[0], side[1], ["pk"], "row")
    op = F.when(F.col("change") == "added", "insert").when(F.col("change") == "removed", "delete").otherwise("update")
    return diff.select(F.lit(table).alias("table_name"), op.alias("op"), "pk", F.coalesce("to", "from").alias("row"))
