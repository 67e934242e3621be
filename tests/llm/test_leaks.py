import random

import numpy as np
from conftest import got

from palimpsest.llm import codes, leaks

WORDS = [a + b for a in ("quarl", "vend", "brisk", "tolm", "harv", "plint", "osk", "drum", "fell", "gant") for b in ("ow", "ery", "ing", "ax", "ule", "ith", "ost", "ern")]
FILL = "the house will come to order and we shall now hear the report of the committee on roads before the vote is taken today".split()


def text(seed, n=60):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


ITEMS = {i: text(i) for i in range(1, 6)}


def doc(stretch, seed=0, around=300):
    r = random.Random(seed)
    fill = [r.choice(FILL) for _ in range(around)]
    k = r.randrange(around)
    return " ".join(fill[:k] + stretch + fill[k:])


def run(spark, docs, items=None):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id long, hits string")
    e = spark.createDataFrame([(i, " ".join(t) if t is not None else None, "en") for i, t in (ITEMS if items is None else items).items()], "item_id long, text string, lang string")
    return got(leaks.find(d, e))


def test_whole_partial_and_altered(spark):
    it = ITEMS[1]
    upper = doc([w.upper() for w in it[10:28]], 2)
    hyphen = doc(" ".join(it[5:30]).replace("ing", "i-\nng", 2).split(" "), 3)
    letters = doc([w[:2] + "x" + w[3:] if i % 6 == 2 else w for i, w in enumerate(it[20:45])], 4)
    replaced = doc([("other" if i % 8 == 5 else w) for i, w in enumerate(it[15:45])], 5)
    inserted = doc(it[30:40] + "(Hear, hear from the left.)".split() + it[40:52], 6)
    accents = doc([w.replace("o", "ö").replace("e", "é") for w in it[:16]], 7)
    docs = [(1, doc(it)), (2, upper), (3, hyphen), (4, letters), (5, replaced), (6, inserted), (7, accents), (8, " ".join(it[:15])), (9, doc(ITEMS[2][:20] + ["and"] * 40 + ITEMS[3][:20], 9))]
    assert run(spark, docs) == {(i, 1) for i in range(1, 9)} | {(9, 2), (9, 3)}


def test_short_fragments_and_other_order_are_no_cases(spark):
    it = ITEMS[1]
    mixed = it[:]
    random.Random(1).shuffle(mixed)
    assert run(spark, [(1, doc(it[10:19])), (2, doc(mixed)), (3, doc([])), (4, doc(it[:9] + FILL + it[30:39]))]) == set()


def test_nulls_empty_and_repeats(spark):
    assert run(spark, [(1, None), (2, ""), (None, doc(ITEMS[1])), (3, "a"), (4, doc(ITEMS[1])), (4, doc(ITEMS[1]))]) == {(4, 1)}
    assert run(spark, []) == set()
    assert run(spark, [(1, doc(ITEMS[1]))], {}) == set()
    assert run(spark, [(1, doc(ITEMS[1]))], {7: ["too", "short"], 8: None}) == set()


def test_very_long_document_and_slices(spark):
    long = " ".join(FILL * 60_000)
    assert len(long) > 3 * codes.GROUP
    at = codes.GROUP - 40
    assert run(spark, [(1, long[:at] + " " + " ".join(ITEMS[4][:18]) + " " + long[at:]), (2, long)]) == {(1, 4)}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", 2)
    assert run(spark, [(i, doc(t, i)) for i, t in ITEMS.items()]) == {(i, i) for i in ITEMS}


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    """Altered, inserted and long-insertion cases through the pass that keeps likely parts, against the search of all items at once."""
    r = random.Random(11)
    docs = []
    for k in range(60):
        it = ITEMS[r.randrange(1, 6)]
        n, s = r.randrange(12, 40), r.randrange(0, 20)
        stretch = [("zzz" if r.random() < 0.12 else w) for w in it[s : s + n]]
        if k % 3 == 0:
            stretch[7:7] = [FILL[i % len(FILL)] for i in range(r.randrange(1, 33))]
        docs.append((k, doc(stretch, k) + (" " + doc(ITEMS[1 + k % 5][:20], k) if k % 7 == 0 else "")))
    whole = run(spark, docs)
    monkeypatch.setattr(leaks, "ITEMS_AT_ONCE", 2)
    assert run(spark, docs) == whole and len(whole) > 40


def test_quick_looks_at_a_match_matrix():
    m = np.zeros((20, 30), bool)
    m[np.arange(17), np.arange(17) + 5] = True
    m[[3, 8, 12], [8, 13, 17]] = False
    assert leaks.in_step(m, 14, 17) and not leaks.in_step(m, 15, 17) and not leaks.in_step(m, 14, 16) and not leaks.in_step(np.zeros((3, 3), bool), 1, 1)
    assert leaks.in_order(m, 11) and not leaks.in_order(m[:, ::-1], 2) and not leaks.in_order(m[:5], 6)


def test_packed_universe():
    r = np.random.default_rng(1)
    known, other = (r.integers(0, 1 << 63, 700_000, dtype=np.uint64) for _ in range(2))
    u = leaks.universe_of(known)
    assert u.packed and u.may_have(known).all() and u.may_have(other).mean() < 0.05
    small = leaks.universe_of(known[:1000])
    assert not small.packed and small.may_have(known[:1000]).all() and small.may_have(other).mean() < 0.01


def test_search_misses_nothing_that_brute_force_finds():
    """All pairs of small documents and items, aligned without any candidate search."""
    t = codes.tables()
    q = leaks.build_query([" ".join(x) for x in ITEMS.values()], t)
    r = random.Random(3)
    texts = []
    for k in range(120):
        it = ITEMS[r.randrange(1, 6)]
        n = r.randrange(5, 40)
        s = r.randrange(0, len(it) - n)
        texts.append(doc([("zzz" if r.random() < 0.1 else w) for w in it[s : s + n]], k))
    w = codes.folded_words(texts, t)
    found = {(a, b) for a, b, lo, hi in leaks.candidate_pairs(w, q) if leaks.verified(w, q, a, b, lo, hi)}
    for a in range(len(texts)):
        for b in range(5):
            mine = w.hashes[w.text == a]
            best = leaks.longest_stretch(q.words[b][:, None] == mine[None, :])
            assert ((a, b) in found) == (best >= leaks.LEAST_SPAN) or leaks.LEAST_SPAN <= best < leaks.STRETCH


def test_word_hashes_depend_on_the_word_alone():
    t = codes.tables()
    w = codes.folded_words(["Über die Straße, uber DIE strasse", "uber"], t)
    assert [w.word(i) for i in (0, 1)] == ["uber", "die"] and w.hashes[0] == w.hashes[3] == w.hashes[-1] and list(w.text) == [0] * 6 + [1]


def test_long_insertions_and_altered_words_in_short_stretches(spark):
    it = ITEMS[1]
    aside = [FILL[i % len(FILL)] for i in range(30)]
    docs = [(p, doc(it[21 : 21 + p] + aside + it[21 + p : 36], p)) for p in range(2, 14)]
    assert run(spark, docs) == {(p, 1) for p in range(2, 14)}
    assert run(spark, [(1, doc(it[21:25] + aside + it[25:30])), (2, doc(it[30:36] + aside + it[21:30]))]) == set()


def test_passages_begin_at_every_word():
    t = codes.tables()
    q = leaks.build_query([" ".join(x) for x in ITEMS.values()], t)
    assert len(q.item) == sum(len(x) - leaks.STRETCH + 1 for x in ITEMS.values())
    lost = 0
    for k in range(300):
        r = random.Random(k)
        stretch = ITEMS[1][k % 46 : k % 46 + 15]
        for i in r.sample(range(1, 14), 5):
            stretch[i] = f"zz{i}zz"
        lost += not leaks.candidate_pairs(codes.folded_words([doc(stretch, k, 60)], t), q)
    assert lost <= 9
