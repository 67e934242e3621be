import numpy as np
import pytest

from palimpsest.llm import codes
from palimpsest.llm import quality as Q

COMMON = "the of and to in a is that for it with as was on be by this are from not we but our have will und die der das in zu den nicht".split()
#: Prose that does not repeat itself: each sentence has words of its own.
PLACES = "north south east west upper lower inner outer first second third fourth fifth sixth seventh eighth".split()
PROSE = "It is no secret that we have been asked for the report on the roads, and the answer is not in the budget that was sent to us by the committee. "
LIST = "".join(f"• Ravhan Bay: Mir{c}nol.\n" for c in "abcdefghijklmnopqrst")
NAMES = "; ".join(f"Marnol, Adar{c} (GL)" for c in "abcdefghijklmnopqrst")
PAPERS = "Agenda\n" + "".join(f"({c}) paper no. {k * 379}/{k + 10}\n" for k, c in enumerate("abcdefghijklmnop", 2))
TABLE = "Place | 2018 | 2019 | 2020\n" + "".join(f"Tegkun Bay | {i} 352 | {i * 7}.3 | {i} %\n" for i in range(10, 40))
TABS = "".join(f"Tegkun\t{i}352\t-\t{i * 7}.3\n" for i in range(10, 40))
JUNK = ["page " * 200, "72d4 6c28 5ac3 54aa 133b 9f36 b8e0 4eca\n" * 20, '<br/> &nbsp; <td></td> Login {{menu}} &gt; [x] <div class="n"> ' * 10, "frphwnvqg zs skqjztxgsc nx nqmstnkbb fzrmv " + "xlwxmzhz sltgfn tn vqfn lxb " * 9, ";l.\\**j.j;;,1>i^~.lijj\\\\>.j; <j>j*1_1^^*1-_t\n" * 9]


def prose(n):
    """n different sentences."""
    return "".join(PROSE.replace("roads", f"{PLACES[k]} roads").replace("budget", f"{PLACES[-k - 1]} budget of the {k * 7 % 13} towns").replace("committee", f"committee of the {PLACES[k * 5 % 16]} side") for k in range(n))


def label(text):
    v = Q.vocabulary(COMMON)
    return str(Q.classes(Q.describe([text], v)[1])[0])


@pytest.mark.parametrize(("text", "want"), [
    (prose(5), "prose"), (prose(12), "prose"), (prose(5).upper(), "prose"), (prose(5).replace(", ", "\n").replace(" that", "\nthat"), "prose"), (prose(3).replace(",", "").replace(".", ""), "prose"),
    (LIST, "list"), (NAMES, "list"), (PAPERS, "list"), ("Agenda\n" + LIST, "list"), (PROSE + "\n" + LIST * 2, "list"), (TABLE, "table"), (TABS, "table"), (PROSE + "\n" + TABLE, "table"), *((j, "junk") for j in JUNK),
    (PROSE * 60, "junk"), ("Thank you very much. " * 300, "junk"), (prose(10) * 60, "junk"), ("00:00 " * 90, "junk"), ("la " * 200, "junk"), ("[no audio] " * 60, "junk"),
    (prose(4) + "We have not.\n" + LIST[:120], "prose"), (prose(6) + "\n" + TABLE[:200], "prose"), ("I thank the House.", "prose"), ("", "prose"), (None, "prose"), ("\n \n", "prose"),
])
def test_classes(text, want):
    assert label(text) == want


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, prose string")


def words(spark):
    return spark.createDataFrame([("en", w) for w in COMMON] + [(None, None)], "lang string, word string")


def test_statistics(spark):
    rows = {r.doc_id: r for r in Q.statistics(frame(spark, [(1, "It is 7.\nNo end\n\n"), (2, None), (3, ""), (None, "x"), (4, "The, the!")]), words(spark)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1].n_words, rows[1].n_lines, rows[1].ended_share, rows[1].common_share) == (4, 2, 0.5, 0.5)
    assert rows[1].mean_word_length == pytest.approx(9 / 4) and rows[1].digit_share == pytest.approx(1 / 11)
    assert rows[4].symbol_share == pytest.approx(2 / 8) and rows[2].n_words == rows[3].n_words == 0 and rows[3].text_class == "prose"


def test_counts_agree_with_plain_python():
    import random
    import re

    r = random.Random(2)
    texts = ["".join(r.choice("ab é,.7\n\t Z-'") for _ in range(r.randrange(0, 200))) for _ in range(60)]
    counts, labels = Q.describe(texts, Q.vocabulary(COMMON))
    for i, t in enumerate(texts):
        assert counts["words"][i] == len(re.findall(r"[^\W\d_]+", t)) and counts["chars"][i] == len(re.sub(r"\s", "", t)) == labels[i].sum()
        assert counts["lines"][i] == sum(bool(x.strip()) for x in t.split("\n")) and counts["digits"][i] == t.count("7")


def test_repeated_ids_ties_and_empty(spark):
    assert Q.statistics(frame(spark, []), words(spark)).count() == 0
    assert Q.statistics(frame(spark, [(1, PROSE), (1, PROSE)]), words(spark)).count() == 2
    assert Q.statistics(frame(spark, [(1, PROSE)]), spark.createDataFrame([], "lang string, word string")).count() == 1


def test_very_long_texts_in_slices_as_if_whole(monkeypatch):
    v = Q.vocabulary(COMMON)
    texts = [TABLE * 300, prose(16), "x", prose(12) * 30, prose(16).replace(". ", ".\n") + TABLE, "word " * 9000, None, NAMES.replace("; ", " ; ") * 40, " ".join("abcdefghij"[i % 10] * (i % 7 + 1) for i in range(4000)) + "."]
    whole = Q.describe(texts, v)
    for size in (997, 5000):
        monkeypatch.setattr(codes, "GROUP", size)
        counts, labels = Q.describe(texts, v)
        for name, x in whole[0].items():
            assert list(counts[name]) == list(x), name
        assert list(Q.classes(labels)) == list(Q.classes(whole[1])) and list(labels.sum(axis=1)) == list(whole[1].sum(axis=1))


def test_classes_of_other_documents_by_their_lines():
    """Documents that the fit has not seen, labelled by an account of their lines that is written apart."""
    import labelled
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    texts = pq.read_table(f"{d}/documents.parquet", columns=["text"]).column("text").to_pylist()
    want = [labelled.CLASS.get(x, x) for x in map(labelled.label, texts)]
    found = Q.classes(Q.describe(texts, Q.vocabulary(pq.read_table(f"{d}/common_words.parquet").column("word").to_pylist()))[1])
    for k in Q.LABELS:
        both = sum(a == b == k for a, b in zip(want, found))
        assert both >= 0.97 * want.count(k) > 20 and both >= 0.97 * list(found).count(k), k


def test_fit_finds_the_states_of_small_documents():
    from palimpsest.llm import fitting

    v = Q.vocabulary(COMMON)
    texts = [prose(k) for k in range(2, 14)] + [LIST[k * 24 :] for k in range(8)] + [TABLE[k * 30 :] for k in range(8)] + [j[k * 9 :] for j in JUNK[1:] for k in range(3)] + [x * 40 for x in ("page ", "la ", "so be it ", "1 2 ")]
    states = ["prose"] * 12 + ["list"] * 8 + ["table"] * 8 + ["unreadable"] * 12 + ["repetition"] * 4
    tables, moves, first = fitting.fit(texts, states, v)
    assert set(tables) == set(Q.EMISSIONS) and np.allclose(np.exp(first).sum(), 1) and (np.diag(moves) > -0.2).all()
    u, _ = Q.measure(texts, v)
    e = sum(tables[n][np.searchsorted(b, u.stats[n], "right")] for n, (b, _) in Q.EMISSIONS.items()) * Q.weight(u.chars)[:, None]
    z = Q.viterbi(e, u.text, len(texts), moves, first)
    assert np.mean(z == np.array([Q.STATES.index(s) for s in states])[u.text]) > 0.95
    with pytest.raises(ValueError):
        fitting.fit([""] * 6001, ["prose"] * 6001, v)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    text = np.repeat(np.arange(6), [0, 1, 2, 3, 5, 4])
    e = rng.normal(size=(len(text), 4)) * 3
    moves, first = rng.normal(size=(4, 4)), rng.normal(size=4)
    got = Q.viterbi(e, text, 6, moves, first)
    from itertools import product

    for k in range(6):
        at = np.flatnonzero(text == k)
        score = lambda p: first[p[0]] + sum(e[a, s] for a, s in zip(at, p)) + sum(moves[a][b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if len(at):
            assert score(tuple(got[at])) == pytest.approx(max(map(score, product(range(4), repeat=len(at)))))


def test_too_many_common_words_are_refused(spark, monkeypatch):
    monkeypatch.setattr(Q, "MOST_COMMON_WORDS", 3)
    with pytest.raises(ValueError):
        Q.statistics(frame(spark, []), words(spark))
