"""Problem 7: items into containers of fixed capacity by best-fit decreasing."""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import prefix_sum
from ..session import cut
from . import codes

#: Classes of characters for WordPunct tokens: a token is a maximal run of WORD or of OTHER.
SPACE, WORD, OTHER = range(3)
#: White space by Unicode, the no-break space among it.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def token_class(code: int) -> int:
    """Letters, marks, digits (numerals of every kind: 7, ½, Ⅳ) and the underscore are WORD."""
    if code in WHITE:
        return SPACE
    cat = unicodedata.category(chr(code))
    return WORD if cat[0] in "LMN" or code == 0x5F else OTHER


def token_classes() -> np.ndarray:
    """token_class of each code point of the basic plane."""
    return np.array([token_class(c) for c in range(65_536)], np.uint8)


def count_tokens(texts: list[str | None], classes: np.ndarray) -> np.ndarray:
    """Number of WordPunct tokens of each text; whole arrays at a time, very long texts in slices."""
    out = np.zeros(len(texts), np.int64)
    last, before = -1, SPACE
    for index, group in codes.groups(texts):
        cp, starts = codes.code_points(group)
        kind = codes.look(classes, cp)
        for c in np.unique(cp[cp > 65_535]):
            kind[cp == c] = token_class(int(c))
        begins = (kind != SPACE) & np.concatenate(([True], kind[1:] != kind[:-1]))
        total = np.concatenate(([0], np.cumsum(begins)))
        counts = total[starts[1:]] - total[starts[:-1]]
        for k in [0] if index[0] == last else []:
            counts[k] -= kind[0] != SPACE and kind[0] == before  # a token that goes on from the slice before
        np.add.at(out, index, counts)
        for k in range(1, len(index)):
            if index[k] == index[k - 1] and kind[starts[k]] != SPACE and kind[starts[k]] == kind[starts[k] - 2] and starts[k] - 2 >= starts[k - 1]:
                out[index[k]] -= 1
        last, before = index[-1], int(kind[-2]) if len(kind) > 1 else SPACE
    return out


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: which of them have open bins; tightest(size) in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity >= size that an open bin has."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(placements, bins) for the numbers of items of each size from 1 to capacity.

    Items of equal size are interchangeable, and so are bins of equal remaining capacity, so equal items go down in runs:
    a placement (size, first, n, bin, per) lays the items of ranks first..first+n-1 among their size into the bins from
    `bin` on, `per` items each. The result is that of placing every item by itself, largest first, into the tightest open
    bin; the cost depends on the distinct sizes (at most the capacity), not on the number of items.
    """
    tree, open_bins = RoomTree(capacity), [deque() for _ in range(capacity + 1)]
    placements, bins = [], 0

    def put(room: int, bin_: int, n: int) -> None:
        if n and room:
            runs = open_bins[room]
            if runs and runs[-1][0] + runs[-1][1] == bin_:
                runs[-1][1] += n
            else:
                runs.append([bin_, n])
            tree.add(room, n)

    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                per = capacity // size
                full, rest = divmod(left, per)
                if full:
                    placements.append((size, rank, full * per, bins, per))
                    put(capacity - per * size, bins, full)
                if rest:
                    placements.append((size, rank + full * per, rest, bins + full, rest))
                    put(capacity - rest * size, bins + full, 1)
                bins += full + bool(rest)
                break
            # a bin stays the tightest for this size until less than size remains
            per = room // size
            run = open_bins[room][0]
            n = min(run[1], left // per)
            if n:
                placements.append((size, rank, n * per, run[0], per))
                take, used = n, n * per
            else:
                placements.append((size, rank, left, run[0], left))
                take, used, per = 1, left, left
            start = run[0]
            run[0] += take
            run[1] -= take
            if not run[1]:
                open_bins[room].popleft()
            tree.add(room, -take)
            put(room - per * size, start, take)
            rank += used
            left -= used
    return placements, bins


def sizes_of(documents: DataFrame) -> DataFrame:
    """(doc_id, size): number of tokens of each text; null and blank texts have size 0. Rows without id are left out; repeated ids are separate items."""
    classes = token_classes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count_tokens(b.column("text").to_pylist(), classes))], ["doc_id", "size"])

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, size long")


#: Most kinds of container; more are refused.
MOST_CAPACITIES = 1_000


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """(capacity, doc_id, piece, of, size): an item whole, or, where it exceeds the capacity by itself, in pieces that fill it, the last one with the rest."""
    kinds = [r.capacity for r in containers.select(F.col("capacity").cast("long").alias("capacity")).where("capacity > 0").distinct().limit(MOST_CAPACITIES + 1).collect()]
    if len(kinds) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} kinds of container")
    capacity = F.explode(F.array(*[F.lit(c) for c in sorted(kinds)]).cast("array<bigint>"))
    each = items.select("doc_id", F.col("size").cast("long").alias("size")).where("doc_id is not null and size > 0").withColumn("capacity", capacity)
    n = F.ceil(F.col("size") / F.col("capacity"))
    piece = F.explode(F.sequence(F.lit(1).cast("long"), n))
    return each.withColumn("piece", piece).withColumn("of", n).select("capacity", "doc_id", "piece", "of", F.when(F.col("piece") < F.col("of"), F.col("capacity")).otherwise(F.col("size") - (F.col("of") - 1) * F.col("capacity")).alias("size"))


def pack(items: DataFrame, containers: DataFrame) -> DataFrame:
    """(capacity, bin, doc_id, piece, of, size): every item (doc_id, size) in a bin, for each capacity of `containers`.

    1. Items are counted by size (at most `capacity` sizes; containers are kinds, a handful of rows). 2. Best-fit
    decreasing runs over these counts. 3. Items take ranks among their size (prefix sums, hot sizes are split) and find
    their bin by (size, rank). Only counts by size reach the driver. Items of size 0 take no room and are left out; ties
    of size go in the fixed order of prefix_sum. Bins count from 0.
    """
    spark = items.sparkSession
    parts = cut(pieces(items, containers))
    counts = parts.groupBy("capacity", "size").agg(F.count("*").alias("n")).collect()  # bounded: one row per capacity and size up to it
    by: dict[int, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r["capacity"], {})[r["size"]] = r["n"]
    table = [(c, *p) for c, h in sorted(by.items()) for p in best_fit_decreasing(h, c)[0]]
    placed = spark.createDataFrame(table, "capacity long, size long, first long, n long, bin long, per long")
    # a size has several placements; ranks meet theirs by block, so that the join stays an equi-join
    width = 4096
    blocks = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n") - 1) / width))))
    ranked = prefix_sum(parts.withColumn("group", F.concat_ws("/", "capacity", "size")).withColumn("item", F.concat_ws("/", F.col("doc_id").cast("string"), "piece")).withColumn("one", F.lit(1)), "group", "item", "one", "rank")
    met = ranked.withColumn("block", F.floor(F.col("rank") / width)).join(blocks, ["capacity", "size", "block"]).where("rank >= first and rank < first + n")
    return met.select("capacity", (F.col("bin") + F.floor((F.col("rank") - F.col("first")) / F.col("per"))).cast("long").alias("bin"), "doc_id", "piece", "of", "size")


def utilisation(packed: DataFrame) -> DataFrame:
    """(capacity, bins, tokens, unused_share) of a packing."""
    out = packed.groupBy("capacity").agg(F.countDistinct("bin").alias("bins"), F.sum("size").alias("tokens"))
    return out.withColumn("unused_share", 1 - F.col("tokens") / (F.col("bins") * F.col("capacity")))
