import random

import brute
from conftest import got
from pyspark.sql import functions as F

from palimpsest.operators import hierarchy as H
from palimpsest.operators.spread import prefix_sum
from palimpsest.plans.core_found import p6_found


def links(spark, pairs):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in pairs], "n string, p string, depth int, root string")
    return H.links_of(df, F.col("n"), F.col("p"))


def found(spark, pairs):
    return H.hierarchy(links(spark, pairs))


def small_forest(seed, n=150):
    r = random.Random(seed)
    pairs = {f"n{i:03}": (f"n{r.randrange(n):03}" if r.random() < 0.12 else f"n{r.randrange(i):03}" if i and r.random() < 0.95 else r.choice([None, "nowhere"])) for i in range(n)}
    return pairs


def test_against_brute_force_with_cycles(spark):
    for seed in range(2):
        pairs = small_forest(seed)
        assert got(found(spark, pairs.items()).select("id", "root", "depth", "state")) == brute.p6(pairs)


def test_nested_sets_paths_and_descendants(spark):
    pairs = {k: (v if v and v < k else None) for k, v in small_forest(7).items()}
    t = found(spark, pairs.items())
    rows = {r.id: r for r in t.join(H.paths(t), "id", "left").collect()}
    below = {(r.id, r.descendant, r.distance) for r in H.descendants(t, t.select("id")).collect()}
    want = set()
    for i in rows:
        path, x = [i], i
        while pairs[x] in rows:
            x = pairs[x]
            path.insert(0, x)
        assert rows[i].path == path and rows[i].depth == len(path) - 1 and rows[i].root == path[0]
        want |= {(a, i, len(path) - 1 - k) for k, a in enumerate(path[:-1])}
    assert below == want
    for i in rows:
        assert rows[i].size == 1 + sum(a == i for a, _, _ in want)
    assert len({(r.root, r.pre) for r in rows.values()}) == len(rows)


def test_deep_chain_and_wide_node(spark):
    chain = [(f"c{i:04}", f"c{i - 1:04}" if i else None) for i in range(700)]
    wide = [("w", None)] + [(f"w{i:04}", "w") for i in range(2000)]
    rows = {r.id: r for r in found(spark, chain + wide).collect()}
    assert rows["c0699"].depth == 699 and rows["c0000"].size == 700 and rows["w"].size == 2001
    assert sorted(rows[f"w{i:04}"].pre for i in range(2000)) == list(range(1, 2001))


def test_cycles_with_long_tails(spark):
    pairs = {"a": "b", "b": "c", "c": "a", "self": "self"} | {f"t{i:02}": f"t{i - 1:02}" if i else "a" for i in range(40)}
    assert got(found(spark, pairs.items()).select("id", "root", "depth", "state")) == brute.p6(pairs)


def test_spelling_repeats_nulls_and_empty(spark):
    pairs = [(" A\n", None), ("a", ""), ("B", "A "), ("b", " a"), (None, "a"), ("", "a"), ("c", "unknown")]
    assert got(found(spark, pairs).select("id", "root", "depth", "state")) == {("a", "a", 0, "tree"), ("b", "a", 1, "tree"), ("c", "c", 0, "tree")}
    assert got(found(spark, [])) == set()


def test_real_commits(spark, small):
    want = {brute.norm(r["commit_hash"]): brute.norm(r["parent"]) for r in brute.rows(small, "commits")}
    assert got(p6_found(spark, small)) == brute.p6(want)


def test_prefix_sum_of_a_hot_group(spark):
    df = spark.createDataFrame([("g" if i % 3 else "h", i, i % 5) for i in range(1000)] + [(None, 5000, 2)], "g string, i int, v int")
    by = {}
    for r in prefix_sum(df, "g", "i", "v", "before", salts=7).collect():
        by.setdefault(r.g, []).append((r.before, r.v))
    for rows in by.values():
        starts = sorted(rows)
        assert starts[0][0] == 0 and sum(v for _, v in rows) == max(b + v for b, v in rows)
        assert {b for b, _ in rows} <= {0} | {b + v for b, v in rows}


def test_depths_and_roots_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 7)
    pairs = small_forest(5)
    assert got(found(spark, pairs.items()).select("id", "root", "depth", "state")) == brute.p6(pairs)


def test_chains_of_ancestors(spark):
    up = spark.createDataFrame([(f"c{i:03}", f"c{i - 1:03}") for i in range(1, 150)] + [("a", "b"), ("b", "c"), ("c", "a")], "id string, parent string")
    of = lambda i, n=None: got(H.chain(up, spark.createDataFrame([(i,)] if i else [], "id string"), n))
    assert of("c140") == {(f"c{140 - k:03}", k) for k in range(141)}
    assert of("c140", 20) == {(f"c{140 - k:03}", k) for k in range(20)} and of("c003", 20) == {(f"c{3 - k:03}", k) for k in range(4)}
    assert of("c000") == {("c000", 0)} and of("a") == {("a", 0), ("b", 1), ("c", 2)} and of(None) == set()


def test_tables_of_rounds_are_removed(spark):
    import os

    from palimpsest.session import checkpoint_folder

    folder = f"{checkpoint_folder(spark)}/tables-{spark.sparkContext.applicationId}".removeprefix("file:")
    before = set(os.listdir(folder))
    t = found(spark, [(f"c{i:04}", f"c{i - 1:04}" if i else None) for i in range(300)])
    assert t.count() == 300 and len(set(os.listdir(folder)) - before) <= 7
