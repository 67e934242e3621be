from datetime import datetime as D

import brute
from conftest import got
from pyspark.sql import functions as F

from palimpsest.operators import references as R
from palimpsest.plans.core_found import p2_found

REFS = "k string, p string, t timestamp, since int, kind string"
PAR = "k string, s timestamp, u timestamp"
T = [D(2026, m, 1) for m in range(1, 7)]


def run(spark, refs, parents):
    r = R.references(spark.createDataFrame([(*x, 0, "") for x in refs], REFS), "a", "p", F.col("k"), F.col("p"), F.col("t"))
    return got(R.orphans(r, R.parents(spark.createDataFrame(parents, PAR), F.col("k"), F.col("s"), F.col("u"))).select("record_key", "missing_key", "kind", "period"))


def test_kinds(spark):
    refs = [("r1", " A\n", T[2]), ("r2", "gone", T[2]), ("r3", "b", T[2]), ("r4", "c", T[2]), ("R5", "d", T[2]), ("r6", "", T[2]), ("r7", None, T[2]), (None, "zz", T[2]), ("r1", "a", T[2])]
    parents = [("a", T[1], None), ("B", T[3], None), ("c", T[1], T[5]), ("d", T[2], None), ("d", T[4], None), (None, T[1], None)]
    assert run(spark, refs, parents) == {("r2", "gone", "missing", "2026-03"), ("r3", "b", "late", "2026-03"), ("r4", "c", "deleted", "2026-03")}


def test_repeated_record_counts_once_with_its_earliest_time(spark):
    assert run(spark, [("r", "x", T[4]), ("r", "x", T[1])], []) == {("r", "x", "missing", "2026-02")}


def test_null_times(spark):
    assert run(spark, [("r", "x", None), ("s", "a", None)], [("a", None, None)]) == {("r", "x", "missing", None)}


def test_empty(spark):
    assert run(spark, [], []) == set()


def test_hot_target(spark):
    assert len(run(spark, [(f"r{i}", "x", T[0]) for i in range(3000)], [("y", T[0], None)])) == 3000


def test_against_brute_force(spark, small):
    assert got(p2_found(spark, small)) == brute.p2(small)
