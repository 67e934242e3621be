"""Problem 8: evaluation texts inside documents, by size-partitioned MinHash containment search."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import codes

#: A case is a stretch of this many consecutive words; passages of items have this length and begin at every word.
STRETCH = 15
#: Document windows have two blocks of this many words, so each stretch lies within one.
BLOCK = 15
#: Number of hash functions; containment of a passage's shingles in a window that makes a candidate, and in which it is verified.
HASHES, SOUGHT, CONTAINED = 32, 0.4, 0.3
#: Window sizes in shingles that bound the partitions.
PARTITIONS = (8, 16, 32, 64)
#: A stretch is accepted from this span of item words, of which this share agree (words at its ends may be altered).
LEAST_SPAN, LEAST_SHARE = 14, 0.8
#: So many matches in so many consecutive words, without any shift, are a case without further alignment.
PLAIN = (14, 17)
#: Cost, in matches, of the one insertion into a stretch that may have any length; then this share of its words agree.
INSERTED, INSERTED_SHARE = 1, 0.9
#: Slices of very long texts overlap by this many characters, more than any stretch that is looked at.
OVERLAP = 4_000
#: Items are searched in blocks of this many, so what is sent to executors is bounded (about 40 KB an item).
ITEMS_AT_ONCE = 2_000
#: Slots of the universe to a shingle of the items, and the least and most (as powers of two) of them; the largest takes 128 MB.
SLOTS, LEAST_POWER, MOST_POWER = 32, 20, 30
#: Words around a window that are kept with it for the second pass, where items go in several blocks.
AROUND = 120


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(2, n): of each word, the hash of it with the next and with the next but one; 0 where the text ends before.

    TESTDATA.md counts altered single words as leaks, so shingles are short: one replaced word costs four of them.
    """
    out = np.zeros((2, len(h)), np.uint64)
    with np.errstate(over="ignore"):
        for k in (1, 2):
            if len(h) > k:
                pair = codes.mixed(h[:-k] * np.uint64(3) + h[k:] * np.uint64(5 + 2 * k))
                out[k - 1, :-k] = np.where(text[:-k] == text[k:], pair | np.uint64(1), np.uint64(0))
    return out


def minima(sh: np.ndarray, starts: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """Least hash of the shingles of each block under one hash function."""
    with np.errstate(over="ignore"):
        x = (sh * a + b) >> np.uint64(16)
    x = np.where(sh == 0, np.uint64((1 << 64) - 1), x).min(axis=0)
    return np.minimum.reduceat(x, starts)


def least_matches(size: int) -> int:
    """Equal minima that a window of `size` shingles needs: half of those expected at containment SOUGHT of a full passage."""
    q = 2 * STRETCH - 3
    jaccard = SOUGHT * q / max(q + size - SOUGHT * q, 1)
    return max(1, int(HASHES * min(jaccard, 1.0) / 4))


@dataclass(frozen=True)
class Query:
    """Passages of the items: which item, their shingles, and per hash function the sorted minima."""

    item: np.ndarray
    words: list[np.ndarray]  # hashes of each item's words
    strings: list[list[str]]
    sizes: np.ndarray  # number of shingles of each passage
    values: list[np.ndarray]
    passages: list[np.ndarray]
    bitmap: np.ndarray
    universe: Universe
    known: np.ndarray  # all shingles of passages, sorted
    members: np.ndarray  # per passage the places of its shingles in known, padded with their number


@dataclass(frozen=True)
class Universe:
    """By the low bits of a shingle, whether any passage may have it; bits are packed where there are many."""

    slots: np.ndarray
    low: np.uint64
    packed: bool

    def may_have(self, sh: np.ndarray) -> np.ndarray:
        at = (sh & self.low).astype(np.int64)
        if self.packed:
            return ((self.slots[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return self.slots[at]


def universe_of(known: np.ndarray) -> Universe:
    """The universe of some shingles, SLOTS for each, so that it lets the same share of others pass for any number of items."""
    power = min(max(LEAST_POWER, int(len(known) * SLOTS).bit_length()), MOST_POWER)
    low = np.uint64((1 << power) - 1)
    at = (known & low).astype(np.int64)
    if power <= 24:
        slots = np.zeros(1 << power, bool)
        slots[at] = True
        return Universe(slots, low, False)
    slots = np.zeros(1 << (power - 3), np.uint8)
    np.bitwise_or.at(slots, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return Universe(slots, low, True)


def build_query(texts: list[str], t: codes.Tables) -> Query:
    w = codes.folded_words(texts, t)
    a, b = _functions()
    item, words, strings, sets, sigs = [], [], [], [], [np.zeros((0, HASHES), np.uint32)]
    over = np.lib.stride_tricks.sliding_window_view
    bounds = np.searchsorted(w.text, np.arange(len(texts) + 1))
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        h = w.hashes[lo:hi]
        words.append(h)
        strings.append([w.word(j) for j in range(lo, hi)])
        if len(h) < STRETCH:
            continue
        sh = shingles(h, np.zeros(len(h), np.int64))
        held = np.concatenate((over(sh[0, :-1], STRETCH - 1), over(sh[1, :-2], STRETCH - 2)), axis=1)  # per passage
        with np.errstate(over="ignore"):
            sigs.append(np.stack([((held * x + y) >> np.uint64(16)).min(axis=1).astype(np.uint32) for x, y in zip(a, b)], axis=1))
        sets.append(np.sort(held, axis=1))
        item += [i] * len(held)
    sig = np.concatenate(sigs)
    bitmap = np.zeros((HASHES, 65_536), bool)
    values, passages = [], []
    for k in range(HASHES):
        order = np.argsort(sig[:, k], kind="stable")
        values.append(sig[order, k])
        passages.append(order.astype(np.int32))
        bitmap[k, sig[:, k] & 65_535] = True
    ordered = np.concatenate(sets) if sets else np.zeros((0, 2 * STRETCH - 3), np.uint64)
    again = np.zeros(ordered.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    known = np.unique(ordered)
    members = np.where(again, len(known), np.searchsorted(known, ordered)).astype(np.int32)
    return Query(np.array(item, np.int64), words, strings, (~again).sum(axis=1), values, passages, bitmap, universe_of(known), known, members)


def likely_windows(w: codes.Words, universe: Universe, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, starts, ends): the windows that hold at least `least` shingles that any passage may have."""
    n = len(w.hashes)
    sh = shingles(w.hashes, w.text)
    first = np.flatnonzero(np.diff(w.text, prepend=-1))  # first word of each text
    start_of = np.repeat(first, np.diff(np.append(first, n)))
    starts = np.flatnonzero((np.arange(n) - start_of) % BLOCK == 0)
    more = np.append(w.text[starts[1:]] == w.text[starts[:-1]], False)  # the next block is of the same text
    ends = np.append(starts[1:], n)
    window_end = np.where(more, np.append(ends[1:], n), ends)
    known = universe.may_have(sh) & (sh > 0)
    shared = np.add.reduceat(known.sum(axis=0), starts)
    shared = shared + np.where(more, np.append(shared[1:], 0), 0)
    keep = shared >= least
    return sh, starts[keep], window_end[keep]


def candidate_pairs(w: codes.Words, q: Query) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, last word + 1): where a window holds enough of a passage of the item, by exact containment.

    Windows with fewer shingles of any passage than verification asks of one are passed over first; that loses nothing.
    """
    if not len(w.hashes) or not len(q.item):
        return []
    sh, starts, window_end = likely_windows(w, q.universe, CONTAINED * q.sizes.min())
    if not len(starts):
        return []
    lengths = window_end - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    held, edges = sh[:, at], np.concatenate(([0], np.cumsum(lengths)[:-1]))
    sizes = np.add.reduceat((held > 0).sum(axis=0), edges)
    a, b = _functions()
    hits = []
    for k in range(HASHES):
        m = minima(held, edges, a[k], b[k]).astype(np.uint32)
        x = np.flatnonzero(q.bitmap[k, m & 65_535])
        lo, hi = np.searchsorted(q.values[k], m[x], "left"), np.searchsorted(q.values[k], m[x], "right")
        for y, l, h in zip(x[hi > lo], lo[hi > lo], hi[hi > lo]):
            hits.append(np.stack((np.full(h - l, y), q.passages[k][l:h].astype(np.int64))))
    if not hits:
        return []
    pairs = np.concatenate(hits, axis=1)
    code, counts = np.unique(pairs[0] * len(q.item) + pairs[1], return_counts=True)
    window, passage = np.divmod(code, len(q.item))
    need = np.array([least_matches(s) for s in PARTITIONS])[np.searchsorted(PARTITIONS, np.minimum(sizes[window], PARTITIONS[-1]))]
    window, passage = window[counts >= need], passage[counts >= need]
    contained = exact_containment(held, edges, lengths, window, passage, q) >= CONTAINED
    out: dict[tuple[int, int], list[int]] = {}
    for x, p in zip(window[contained], passage[contained]):
        lo, hi = int(starts[x]), int(window_end[x])
        span = out.setdefault((int(w.text[lo]), int(q.item[p])), [lo, hi])
        span[0], span[1] = min(span[0], lo), max(span[1], hi)
    return [(text, item, lo, hi) for (text, item), (lo, hi) in out.items()]


def exact_containment(held: np.ndarray, edges: np.ndarray, lengths: np.ndarray, window: np.ndarray, passage: np.ndarray, q: Query) -> np.ndarray:
    """Share of each passage's shingles that its window holds; windows in blocks, so that memory is bounded."""
    out = np.zeros(len(window))
    block = max(1, min(256, 30_000_000 // (len(q.known) + 1)))  # present takes 30 MB at most
    for lo in range(0, len(edges), block):
        a, b = np.searchsorted(window, [lo, lo + block])
        if a == b:
            continue
        hi = min(lo + block, len(edges))
        cells = held[:, edges[lo] : edges[hi - 1] + lengths[hi - 1]]
        owner = np.repeat(np.arange(hi - lo), lengths[lo:hi])
        at = np.minimum(np.searchsorted(q.known, cells), len(q.known) - 1)
        r, c = np.nonzero(q.known[at] == cells)
        present = np.zeros((hi - lo, len(q.known) + 1), bool)
        present[owner[c], at[r, c]] = True
        for i in range(a, b, 65_536):
            j = min(i + 65_536, b)
            out[i:j] = present[window[i:j, None] - lo, q.members[passage[i:j]]].sum(axis=1) / q.sizes[passage[i:j]]
    return out


def alike(x: str, y: str) -> bool:
    """Equal but for one letter replaced, added or lost (two in words of eight letters or more)."""
    if x == y:
        return True
    if abs(len(x) - len(y)) > 2 or min(len(x), len(y)) < 3:
        return False
    p = 0
    while p < min(len(x), len(y)) and x[p] == y[p]:
        p += 1
    s = 0
    while s < min(len(x), len(y)) - p and x[-1 - s] == y[-1 - s]:
        s += 1
    longest = max(len(x), len(y))
    return p + s >= longest - (2 if longest >= 8 else 1)


def in_step(m: np.ndarray, hits: int, span: int) -> bool:
    """Whether some `span` consecutive item words have `hits` matches at one and the same distance from the document's words."""
    i, j = np.nonzero(m)
    order = np.lexsort((i, j - i))
    i, distance = i[order], (j - i)[order]
    last = hits - 1
    return len(i) >= hits and bool(((distance[last:] == distance[: len(i) - last]) & (i[last:] - i[: len(i) - last] < span)).any())


def longest_stretch(m: np.ndarray) -> int:
    """Span of item words in the best local alignment of a match matrix (item words x document words).

    A match counts 1, a replaced word or one left out -1, a word inserted in the document -1/2; one insertion, of any
    length, costs no more than INSERTED. Of all alignments whose share of matches is at least LEAST_SHARE (INSERTED_SHARE
    past such an insertion) the longest span of item words is returned; the insertion is tried where no stretch is long
    enough without it and LEAST_SPAN words hold enough matches, two less than all, for that share.
    """
    best = _aligned(m, 1)
    return max(best, _aligned(m, 2)) if best < LEAST_SPAN and any(dense_rows(m.any(axis=1), LEAST_SPAN - 2)) else best


def _aligned(m: np.ndarray, n_layers: int) -> int:
    """longest_stretch() without the long insertion (one layer) or with it (two)."""
    ni, nj = m.shape
    half, best = np.arange(nj + 1) / 2, 0
    fresh = lambda: (np.zeros(nj + 1), np.zeros(nj + 1, np.int64), np.zeros(nj + 1, np.int64))
    layers = [fresh() for _ in range(n_layers)]  # score, began, hits: before the one long insertion and after it

    def furthest(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best place to come from, any number of words further left, and its value."""
        top = np.maximum.accumulate(value)
        return top[:-1], np.maximum.accumulate(np.where(value >= top, np.arange(nj + 1), 0))[:-1]

    for i in range(ni):
        row, earlier = m[i], layers[0]
        for k, (score, began, hits) in enumerate(layers):
            top, come = furthest(score + half)
            before = top - half[:-1]
            b0, h0 = began[come], hits[come]
            if k:
                jump, jump_from = furthest(earlier[0])
                jump = jump - INSERTED
                far = jump > before
                before, b0, h0 = np.where(far, jump, before), np.where(far, earlier[1][jump_from], b0), np.where(far, earlier[2][jump_from], h0)
            opened = before > 0
            on = np.where(row, np.where(opened, before, 0) + 1, score[:-1] - 1)
            live = np.where(row, opened, score[:-1] > 0)
            b = np.where(live, np.where(row, b0, began[:-1]), i)
            h = np.where(live, np.where(row, h0, hits[:-1]), 0) + row
            left = score[1:] - 1
            use = left > on
            on, b, h = np.where(use, left, on), np.where(use, began[1:], b), np.where(use, hits[1:], h)
            good = (on > 0) & row & ~use & (h >= (INSERTED_SHARE if k else LEAST_SHARE) * (i + 1 - b))
            if good.any():
                best = max(best, int((i + 1 - b)[good].max()))
            layers[k] = tuple(np.concatenate((z[:1], x)) for z, x in zip(fresh(), (np.maximum(on, 0), b, h)))
    return best


def dense_rows(rows: np.ndarray, least: int) -> tuple[int, int]:
    """Range of rows around the places where at least `least` of LEAST_SPAN consecutive ones are true; (0, 0) if there is none."""
    total = np.concatenate(([0], np.cumsum(rows)))
    at = np.flatnonzero(total[LEAST_SPAN:] - total[:-LEAST_SPAN] >= least) if len(rows) >= LEAST_SPAN else ()
    return (max(0, at[0] - LEAST_SPAN), min(len(rows), at[-1] + 2 * LEAST_SPAN)) if len(at) else (0, 0)


def in_order(m: np.ndarray, least: int) -> bool:
    """Whether some LEAST_SPAN consecutive rows have `least` matches in order: a longest increasing subsequence per window of rows."""
    places = [np.flatnonzero(row)[::-1].tolist() for row in m]
    filled = np.concatenate(([0], np.cumsum([bool(p) for p in places])))
    for r in range(max(len(places) - LEAST_SPAN + 1, 1)):
        if filled[min(r + LEAST_SPAN, len(places))] - filled[r] < least:
            continue
        ends: list[int] = []  # least place at which a run of each length ends
        for row in places[r : r + LEAST_SPAN]:
            for j in row:
                k = bisect_left(ends, j)
                ends[k : k + 1] = [j]
        if len(ends) >= least:
            return True
    return False


def verified(w: codes.Words, q: Query, text: int, item: int, lo: int, hi: int) -> bool:
    """The exact check: the item's words in order, altered letters, single other words and insertions allowed.

    Only those of the item's words are aligned around which enough are there, in whatever order; elsewhere no stretch can lie.
    """
    first, last = np.searchsorted(w.text, [text, text + 1])
    lo, hi = max(lo - 40, first), min(hi + 40, last)
    m = q.words[item][:, None] == w.hashes[None, lo:hi]
    r0, r1 = dense_rows(m.any(axis=1), LEAST_SPAN // 2)
    m = m[r0:r1]
    if in_step(m, *PLAIN):
        return True
    if r0 == r1:
        return False
    near = np.flatnonzero(m.any(axis=0))
    lo2, hi2 = max(0, near[0] - 16), min(hi - lo, near[-1] + 17)
    m = m[:, lo2:hi2].copy()
    names = [w.word(j) for j in range(lo + lo2, lo + hi2)]
    known = set(q.strings[item])
    ends: dict[str, list[int]] = {}  # words the item does not have, by first and by last letter
    for j, x in enumerate(names):
        if x not in known and len(x) >= 3:
            ends.setdefault("^" + x[0], []).append(j)
            ends.setdefault(x[-1] + "$", []).append(j)
    for i, x in enumerate(q.strings[item][r0:r1]):
        if len(x) >= 3:
            for j in ends.get("^" + x[0], []) + ends.get(x[-1] + "$", []):
                y = names[j]
                # one of the outer two letters at either end is kept in all but the longest words
                if -2 <= len(x) - len(y) <= 2 and (x[:2] == y[:2] or x[-2:] == y[-2:] or len(x) < 5) and alike(x, y):
                    m[i, j] = True
    least = int(LEAST_SHARE * LEAST_SPAN) - 1  # what any stretch has in one of its windows
    r0, r1 = dense_rows(m.any(axis=1), least)
    return r0 < r1 and in_order(m[r0:r1], least) and longest_stretch(m[r0:r1]) >= LEAST_SPAN


def likely_parts(texts: list[str | None], universe: Universe, least: float, t: codes.Tables) -> Iterator[tuple[int, str]]:
    """(text, part): the words around likely windows, folded; windows less than AROUND words apart share a part."""
    for index, group in codes.groups(texts, OVERLAP):
        w = codes.folded_words(group, t)
        if not len(w.hashes):
            continue
        _, starts, ends = likely_windows(w, universe, least)
        if not len(starts):
            continue
        lo = np.maximum(starts - AROUND, np.searchsorted(w.text, w.text[starts]))
        hi = np.minimum(ends + AROUND, np.searchsorted(w.text, w.text[starts], "right"))
        new = np.concatenate(([True], (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (w.text[starts[1:]] != w.text[starts[:-1]])))
        at = np.flatnonzero(new)
        for a, b in zip(at, [*at[1:], len(lo)]):
            yield index[w.text[starts[a]]], " ".join(w.word(j) for j in range(lo[a], hi[a:b].max()))


def find(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents (doc_id, text) that hold a stretch of at least fifteen consecutive words of an item (item_id, text).

    The passages of the items are the queries. Each document is cut into windows, whose MinHash signatures are compared
    with those of the passages; how many minima must agree depends on the partition of the window's size. Candidates are
    verified by exact containment of the passage's shingles, then by alignment in order. Every document passes whole.
    Items go in blocks of ITEMS_AT_ONCE; where there are several, one pass over the documents keeps what is around windows
    that hold enough shingles of any item at all, and the blocks are searched in that. Null and short texts hold nothing;
    rows without id are left out. Nothing is shuffled but the pairs found.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    n_blocks = max(1, -(-items.count() // ITEMS_AT_ONCE))
    t = codes.tables()
    part = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    block = lambda k: items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()  # noqa: E731 - about ITEMS_AT_ONCE rows
    if n_blocks > 1:
        known, least = np.zeros(0, np.uint64), float("inf")
        for k in range(n_blocks):
            query = build_query([r.text for r in block(k)], t)
            known, least = np.union1d(known, query.known), min(least, CONTAINED * query.sizes.min(initial=2 * STRETCH))
        universe = universe_of(known)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                docs = b.column("doc_id").to_pylist()
                found = [(docs[i], text) for i, text in likely_parts(b.column("text").to_pylist(), universe, least, t)]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["doc_id", "text"])

        part = cut(part.mapInArrow(keep, "doc_id long, text string"))
    found = None
    for k in range(n_blocks):
        rows = block(k)
        ids, query = np.array([r.item_id for r in rows], np.int64), build_query([r.text for r in rows], t)

        def search(batches: Iterator[pa.RecordBatch], ids=ids, query=query) -> Iterator[pa.RecordBatch]:
            for b in batches:
                docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                out_d, out_i = [], []
                for index, group in codes.groups(texts, OVERLAP):
                    w = codes.folded_words(group, t)
                    for text, item, lo, hi in candidate_pairs(w, query):
                        if verified(w, query, text, item, lo, hi):
                            out_d.append(docs[index[text]])
                            out_i.append(int(ids[item]))
                yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.int64()), pa.array(out_i, pa.int64())], ["doc_id", "item_id"])

        pairs = part.mapInArrow(search, "doc_id long, item_id long")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()
