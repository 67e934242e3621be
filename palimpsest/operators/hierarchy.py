"""Problem 6: parent-child rows to trees with nested-set ranges; cycles are what stays unprocessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import reference
from ..session import cut, cut_with, passing
from .spread import prefix_sum

#: Positions of a forest are swept in blocks of this many.
BLOCK = 65_536


def links_of(df: DataFrame, node: Column, parent: Column) -> DataFrame:
    """(id, parent): one row per stored node; a parent that is not stored is none.

    Rows without a key are left out; of unlike repeats of a node the least parent holds.
    """
    nodes = df.select(reference(node).alias("id"), reference(parent).alias("parent")).where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    nodes = cut(nodes)
    known = nodes.select(F.col("id").alias("parent")).join(nodes.where("parent is not null").select("id", "parent"), "parent").select("id", F.col("parent").alias("up"))
    return nodes.select("id").join(known, "id", "left").select("id", F.col("up").alias("parent"))


def numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((n, id, parent), (n, up)): a number for each node, stored with it, so that all later joins are on numbers; up is null for roots."""
    named = cut(links.select(F.monotonically_increasing_id().alias("n"), "id", "parent"))
    parent = named.select(F.col("id").alias("parent"), F.col("n").alias("up"))
    return named, cut(named.select("n", "parent").join(parent, "parent", "left").select("n", "up"))


def subtree_sizes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upward, over (n, up): ((n, size), cyclic n).

    Pointers double each round: a node adds the sizes of the nodes exactly 2^k steps below, so after round k it has
    counted all descendants nearer than 2^(k+1), and log2(depth) rounds suffice instead of one per level. Nodes whose
    pointer has run out leave the loop with the size they have; what they receive later is added up at the end, so no
    finished row is written again. When neither the number of pointers nor of their targets changes any more, what is
    left lies on or under cycles, and the targets are the cycles themselves. Sizes mean something for trees only.
    """
    one = F.lit(1).cast("long")
    live = links.where("up is not null").select("n", F.col("up").alias("anc"), one.alias("size"))
    done = [links.where("up is null").select("n", one.alias("size"))]
    seen = None
    while True:
        adds, counts = cut_with(live.groupBy("anc").agg(F.try_sum("size").alias("add"), F.count("*").alias("k")), targets=F.count("*"), pointers=F.sum("k"))
        now = (counts["targets"], counts["pointers"])
        if not now[0] or now == seen:
            sizes = done[0]
            for d in done[1:]:
                sizes = sizes.unionByName(d)
            return cut(sizes.groupBy("n").agg(F.sum("size").alias("size"))), cut(adds.select(F.col("anc").alias("n")))
        seen = now
        gained = live.join(adds.select(F.col("anc").alias("n"), "add"), "n", "left").select("n", "anc", F.try_add("size", F.coalesce("add", F.lit(0).cast("long"))).alias("size"))
        state = cut(gained.join(live.select(F.col("n").alias("anc"), F.col("anc").alias("next")), "anc", "left").select("n", F.col("next").alias("anc"), "size"))
        # what nodes outside the loop receive
        done += [adds.join(live.select(F.col("n").alias("anc")), "anc", "left_anti").select(F.col("anc").alias("n"), F.col("add").alias("size")), state.where("anc is null").select("n", "size")]
        live = state.where("anc is not null")


def positions(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Downward: (n, pre) of tree nodes, the places of a preorder of the whole forest, from 0 without gaps.

    Siblings (and roots) share their parent's range by prefix sums over their sizes; a hot parent's children are split over
    many windows. Offsets add up along doubled pointers; nodes that have reached a root leave the loop.
    """
    placed = prefix_sum(links.join(sizes, "n"), "up", "n", "size", "off")
    state = cut(placed.select("n", F.col("up").alias("anc"), F.when(F.col("up").isNull(), F.col("off")).otherwise(F.col("off") + 1).alias("off")))
    done, live, left = state.where("anc is null").select("n", "off"), state.where("anc is not null"), None
    while True:
        far = done.select(F.col("n").alias("anc"), F.lit(None).cast("long").alias("next"), F.col("off").alias("more")).unionByName(live.select(F.col("n").alias("anc"), F.col("anc").alias("next"), F.col("off").alias("more")))
        state, counts = cut_with(live.join(far, "anc").select("n", F.col("next").alias("anc"), F.try_add("off", "more").alias("off")), live=F.count("anc"))
        done, live = done.unionByName(state.where("anc is null").select("n", "off")), state.where("anc is not null")
        if not counts["live"] or counts["live"] == left:
            return done.select("n", F.col("off").alias("pre"))
        left = counts["live"]


def ranges(tree: DataFrame) -> DataFrame:
    """(n, pre, size) with `depth` and `top`, the root's n, both read from the nested-set ranges alone.

    In a forest's preorder without gaps a node has as many ancestors as ranges that began before it and have not ended:
    its place less the ends up to it. Its root is the last place of depth 0. Places are swept in blocks, each of which
    starts from the ends and the last root of those before it (one row per block).
    """
    at = lambda p: F.floor(p / BLOCK).alias("block")
    begins = tree.select(at(F.col("pre")), F.col("pre").alias("p"), F.lit(1).alias("kind"), "n", "size")
    ends = tree.select(at(F.col("pre") + F.col("size")), (F.col("pre") + F.col("size")).alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("size"))
    upto = W.partitionBy("block").orderBy("p", "kind").rowsBetween(W.unboundedPreceding, 0)
    within = cut(begins.unionByName(ends).withColumn("ended", F.count_if(F.col("kind") == 0).over(upto)))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = within.groupBy("block").agg(F.count_if(F.col("kind") == 0).alias("t"))
    before = totals.select("block", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))
    deep = within.where("kind = 1").join(before, "block").select("block", "p", "n", "size", (F.col("p") - F.col("ended") - F.col("before")).alias("depth"))
    deep = cut(deep)
    root = F.when(F.col("depth") == 0, F.col("n"))
    last = deep.groupBy("block").agg(F.max(F.when(F.col("depth") == 0, F.struct("p", "n"))).alias("m")).select("block", F.col("m.n").alias("r"))
    carried = last.select("block", F.last("r", True).over(earlier).alias("carried"))
    here = deep.withColumn("here", F.last(root, True).over(W.partitionBy("block").orderBy("p").rowsBetween(W.unboundedPreceding, 0)))
    return here.join(carried, "block").select("n", F.col("p").alias("pre"), "size", "depth", F.coalesce("here", "carried").alias("top"))


def hierarchy(links: DataFrame) -> DataFrame:
    """(id, parent, root, depth, size, pre, state) for each node of links_of().

    `pre` counts from 0 at each root; u is a descendant of v iff they have the same root and pre(v) < pre(u) < pre(v) +
    size(v). state: tree, in_cycle (own ancestor) or under_cycle; the latter two have root '', depth -1, pre and size null.
    Empty input gives an empty result.
    """
    named, links = numbered(links)
    with passing() as keep:
        sizes, cyclic = map(keep, subtree_sizes(links))
    with passing() as keep:
        placed = keep(cut(positions(links, sizes).join(sizes, "n")))
    with passing() as keep:
        tree = keep(cut(ranges(placed)))
    tops = tree.where("depth = 0").select(F.col("n").alias("top"), F.col("pre").alias("start")).join(named.select(F.col("n").alias("top"), F.col("id").alias("root")), "top")
    found = tree.join(tops, "top").join(named, "n").select("id", "parent", "root", "depth", "size", (F.col("pre") - F.col("start")).alias("pre"), F.lit("tree").alias("state"))
    rest = named.join(placed.select("n"), "n", "left_anti").join(cyclic.withColumn("own", F.lit(True)), "n", "left").select(
        "id", "parent", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("pre"),
        F.when(F.col("own"), "in_cycle").otherwise("under_cycle").alias("state"),
    )
    return found.unionByName(rest)


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """(id, descendant, distance) for the ids of `of`, by nested-set ranges within each root.

    A root's nodes are cut into blocks of preorder positions; a range meets a node only in the blocks it covers, so the
    join is on (root, block) and its output is the answer itself.
    """
    width = 1024
    t = tree.where("state = 'tree'")
    wide = t.join(of.select("id").distinct(), "id").select(
        F.col("id").alias("above"), "root", F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"), F.col("depth").alias("level"),
    ).where("hi > lo + 1").withColumn("block", F.explode(F.sequence(F.floor((F.col("lo") + 1) / width), F.floor((F.col("hi") - 1) / width))))
    nodes = t.select(F.col("id").alias("descendant"), "root", "pre", "depth", F.floor(F.col("pre") / width).alias("block"))
    return wide.join(nodes, ["root", "block"]).where("pre > lo and pre < hi").select(F.col("above").alias("id"), "descendant", (F.col("depth") - F.col("level")).alias("distance"))


def paths(tree: DataFrame) -> DataFrame:
    """(id, path): the ids from the root to each tree node, by doubling over (id, parent); the result is the sum of all depths long."""
    t = tree.where("state = 'tree'")
    state = cut(t.select("id", F.col("parent").alias("anc"), F.array("id").alias("path")))
    done, live = state.where("anc is null").select("id", "path"), state.where("anc is not null")
    left = None
    while left != 0:
        far = done.select(F.col("id").alias("anc"), F.lit(None).cast("string").alias("next"), F.col("path").alias("head")).unionByName(live.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("path").alias("head")))
        state, counts = cut_with(live.join(far, "anc").select("id", F.col("next").alias("anc"), F.concat("head", "path").alias("path")), live=F.count("anc"))
        done, live, left = done.unionByName(state.where("anc is null").select("id", "path")), state.where("anc is not null"), counts["live"]
    return done


def chain(links: DataFrame, tip: DataFrame, steps: int | None = None) -> DataFrame:
    """(id, distance): the tip (one id) at distance 0 and its ancestors, `steps` nodes at most.

    Pointers of all nodes double, and the nodes found so far are joined with them, so each round doubles the length of the
    chain; it ends when the chain is long enough or has no more ancestors. On a cycle it goes round, until `steps` are
    reached or an ancestor is met again.
    """
    ptr = links.where("parent is not null").select("id", F.col("parent").alias("anc"))
    found, counts = cut_with(tip.select("id", F.lit(0).cast("long").alias("distance")), n=F.count("*"))
    n, step = counts["n"], 1
    while n == step and (steps is None or step < steps):
        further = found.join(ptr, "id").select(F.col("anc").alias("id"), (F.col("distance") + step).alias("distance"))
        both = found.unionByName(further).groupBy("id").agg(F.min("distance").alias("distance"))
        found, counts = cut_with(both, n=F.count("*"))
        n, step = counts["n"], step * 2
        if n == step and (steps is None or step < steps):
            ptr = cut(ptr.alias("p").join(ptr.alias("q"), F.col("p.anc") == F.col("q.id")).select("p.id", "q.anc"))
    return found if steps is None else found.where(F.col("distance") < steps)
