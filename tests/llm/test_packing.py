import random

import pytest
import regex
from conftest import got
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import packing as P


def one_by_one(histogram, capacity):
    rooms = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fit = min((r for r in rooms if r >= size), default=None)
            if fit is None:
                rooms.append(capacity - size)
            else:
                rooms[rooms.index(fit)] -= size
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 50).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 25), max_size=10))))
def test_same_as_placing_item_by_item(case):
    capacity, histogram = case
    placements, bins = P.best_fit_decreasing(histogram, capacity)
    load, placed = [0] * bins, {}
    for size, first, n, bin_, per in placements:
        assert placed.get(size, 0) == first
        placed[size] = first + n
        for i in range(n):
            load[bin_ + i // per] += size
    assert placed == histogram
    assert sorted(capacity - x for x in load) == one_by_one(histogram, capacity)


def pack(spark, items, *capacities):
    df = spark.createDataFrame([(i, s, 0, "x", 9) for i, s in items], "doc_id long, size long, piece int, bin string, capacity int")
    return P.pack(df, spark.createDataFrame([(k, c) for k, c in enumerate(capacities)], "container_id int, capacity long")).collect()


def test_every_item_once_within_capacity(spark):
    r = random.Random(5)
    items = [(i, r.choice([0, 7, 7, 7, r.randrange(1, 60)])) for i in range(400)] + [(500, 230), (None, 5), (501, None)]
    rows = pack(spark, items, 50, 100)
    for c in (50, 100):
        load, sizes = {}, {}
        for x in (x for x in rows if x.capacity == c):
            load[x.bin] = load.get(x.bin, 0) + x.size
            sizes.setdefault(x.doc_id, []).append((x.piece, x.size, x.of))
        assert max(load.values()) <= c and set(load) == set(range(len(load)))
        assert {i: sum(s for _, s, _ in p) for i, p in sizes.items()} == {i: s for i, s in items if i is not None and s}
        for i, p in sizes.items():
            p.sort()
            total = sum(s for _, s, _ in p)
            assert [k for k, _, _ in p] == list(range(1, -(-total // c) + 1)) and all(s == c for _, s, _ in p[:-1])


def test_hot_size_ties_and_repeats(spark):
    rows = pack(spark, [(1, 5)] * 3 + [(i, 5) for i in range(2, 3000)], 10)
    assert len(rows) == 3001 and len({x.bin for x in rows}) == 1501


def test_empty(spark):
    assert pack(spark, [], 10) == [] and pack(spark, [(1, 5)]) == [] and pack(spark, [(1, 5)], 0) == []


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("  \n", 0), ("a b", 2), ("don't stop!", 5), ("x_1 ...é", 3), ("été ?!", 2), ("a b", 2), ("ab" * 300_000, 1), ("a, " * 100_000, 200_000)])
def test_token_counts(spark, text, n):
    df = spark.createDataFrame([(1, text, 7)], "doc_id long, text string, size int")
    assert got(P.sizes_of(df)) == {(1, n)}


def test_token_counts_in_slices_agree_with_a_regex(monkeypatch):
    monkeypatch.setattr(P.codes, "GROUP", 50)
    pattern, r, classes = regex.compile(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\p{White_Space}]+"), random.Random(1), P.token_classes()
    for _ in range(200):
        texts = ["".join(r.choice("ab é_,.7\n\u2003\u00a0𝐀😀½-'") for _ in range(r.choice([0, 3, 40, 160, 400]))) if r.random() > 0.1 else None for _ in range(6)]
        assert list(P.count_tokens(texts, classes)) == [len(pattern.findall(x or "")) for x in texts]
    assert list(P.count_tokens(["a" * 500, "." * 120 + "b" * 200], classes)) == [1, 2]


def test_token_counts_agree_with_a_count_by_characters(small):
    """Written apart from the operator: one character at a time, over all documents of the smallest tables."""
    import unicodedata

    import pyarrow.parquet as pq

    def count(text):
        n, before = 0, " "
        for c in text:
            kind = " " if c.isspace() else "w" if c == "_" or unicodedata.category(c)[0] in "LMN" else "o"
            n += kind != " " and kind != before
            before = kind
        return n

    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert list(P.count_tokens(texts, P.token_classes())) == [count(t or "") for t in texts]


def test_utilisation(spark):
    df = spark.createDataFrame([(10, 0, 6), (10, 0, 4), (10, 1, 5)], "capacity long, bin long, size long")
    assert got(P.utilisation(df).select("capacity", "bins", "tokens", F.round("unused_share", 3))) == {(10, 2, 15, 0.25)}
