"""Problem 9: per-document text statistics; a hidden Markov model labels lines prose, list, table or junk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes

LABELS = ("prose", "list", "table", "junk")
#: States of the model and their labels: junk is either unreadable or endless repetition, which look unlike.
STATES = ("prose", "list", "table", "unreadable", "repetition")
LABEL_OF = np.array([0, 1, 2, 3, 3])
#: Lines of more tokens than LONG are cut into units of PIECE tokens, so that a text on one line has as many observations as a wrapped one.
LONG, PIECE = 30, 20
#: A token counts as repeated when it lies in a sequence of so many tokens that occurs so many times in the text.
REPEATED_TOKENS, REPEATED_TIMES = 12, 3
#: Most common words that are sent to executors; a longer list is refused.
MOST_COMMON_WORDS = 1_000_000

#: Bounds of the bins of each line statistic, and the log-likelihood of each bin under each state,
#: as fitting.fit() found it on 5,500 labelled documents and 320 texts of sentences or tokens said again and again.
EMISSIONS: dict[str, tuple[tuple[float, ...], tuple[tuple[float, ...], ...]]] = {
    # share of words that are common ones
    "common": ((0.07, 0.15, 0.23), ((-4.0, -0.2, -0.2, -0.4, -2.0), (-5.5, -6.0, -6.0, -1.7, -4.4), (-4.0, -3.5, -6.0, -2.5, -5.3), (-0.0, -1.8, -1.8, -2.4, -0.2))),
    # share of digits among the characters
    "digits": ((0.02, 0.09, 0.2), ((-0.4, -0.4, -4.5, -1.1, -0.7), (-1.2, -1.8, -6.0, -1.0, -1.4), (-4.0, -5.5, -4.0, -2.4, -3.4), (-5.3, -2.0, -0.0, -1.5, -1.6))),
    # share of tokens that are numbers, signs for none, or separators
    "cells": ((0.12, 0.3), ((-0.1, -1.1, -4.6, -0.5, -0.2), (-2.9, -1.1, -6.0, -1.4, -3.3), (-5.5, -1.2, -0.0, -2.1, -1.9))),
    # share of words with a capital first letter
    "capital": ((0.2, 0.5), ((-0.3, -2.0, -6.0, -0.0, -0.3), (-1.4, -6.0, -6.0, -3.2, -2.1), (-3.8, -0.1, -0.0, -5.5, -2.1))),
    # share of vowels among the letters
    "vowels": ((0.2, 0.28), ((-6.0, -6.0, -6.0, -1.3, -4.6), (-6.0, -3.0, -2.1, -1.5, -4.7), (-0.0, -0.1, -0.1, -0.7, -0.0))),
    # share of characters of markup, code or broken encoding
    "odd": ((0.03, 0.1), ((-0.0, -0.0, -0.0, -0.4, -0.0), (-4.9, -6.0, -6.0, -6.0, -5.9), (-6.0, -6.0, -4.0, -1.1, -3.2))),
    # share of words of one letter
    "single": ((0.25, 0.5), ((-0.0, -0.0, -0.0, -1.7, -0.0), (-6.0, -6.0, -6.0, -4.0, -4.5), (-6.0, -6.0, -6.0, -0.2, -3.8))),
    # share of tokens that mix letters and digits
    "mixed": ((0.15, 0.4), ((-0.0, -0.0, -0.3, -0.5, -0.0), (-6.0, -6.0, -1.4, -2.5, -3.9), (-6.0, -6.0, -6.0, -1.3, -4.5))),
    # share of tokens in a sequence that the text repeats again and again
    "repeated": ((0.6, 0.9), ((-0.0, -0.0, -0.0, -0.0, -9.8), (-6.8, -9.4, -9.4, -8.5, -9.8), (-8.6, -9.4, -7.5, -8.5, -0.0))),
    # signs (comma, colon, bracket, bullet and the like) to a token
    "signs": ((0.3, 0.5), ((-0.1, -4.4, -2.0, -0.4, -0.2), (-2.9, -6.0, -1.6, -6.0, -3.0), (-3.6, -0.0, -0.4, -1.1, -1.9))),
    # line begins with a bullet or number, or ends with a semicolon
    "marked": ((0.5,), ((-0.0, -1.5, -0.0, -0.0, -0.0), (-5.2, -0.3, -6.0, -4.0, -5.3))),
}
#: Fixed values, fitted alike: log-probabilities of the state of the next unit (rows: the present one), and of the first.
MOVES = ((-0.0, -6.0, -6.0, -6.0, -6.0), (-6.0, -0.0, -6.0, -6.0, -6.0), (-6.0, -6.0, -0.0, -6.0, -6.0), (-6.0, -6.0, -6.0, -0.0, -6.0), (-6.0, -6.0, -6.0, -6.0, -0.0))
FIRST = (-0.1, -3.7, -3.8, -3.8, -2.8)

#: Characters of markup, code and broken encoding.
ODD = "<>{}\\^~_#*=`@$+[]/&|�ÃÂï¿½€™¬¤¶©­"
_BULLETS = "•-*–—·▪◦‣○●"
_ENDS = ".!?…:;\"'”’»)"


@dataclass(frozen=True)
class Units:
    """Statistics of the units of texts; one row per unit, in order."""

    text: np.ndarray
    chars: np.ndarray
    stats: dict[str, np.ndarray]


@dataclass(frozen=True)
class Vocabulary:
    tables: codes.Tables
    common: np.ndarray  # sorted hashes
    odd: np.ndarray
    bullet: np.ndarray
    ending: np.ndarray


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(65_536, bool)
    out[[ord(c) for c in chars]] = True
    return out


def vocabulary(words: list[str]) -> Vocabulary:
    t = codes.tables()
    return Vocabulary(t, np.unique(codes.folded_words(words, t).hashes), _flags(ODD), _flags(_BULLETS), _flags(_ENDS))


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _grams(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash of each REPEATED_TOKENS tokens in a row of one text, by their first token; 0 where the text ends before."""
    n = len(h) - REPEATED_TOKENS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    with np.errstate(over="ignore"):
        g = codes.mixed(codes.span_hashes(h, at, at + REPEATED_TOKENS) + text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.where(text[:n] == text[REPEATED_TOKENS - 1 :], g, np.uint64(0))


def _often(grams: np.ndarray, known: np.ndarray | None, n: int) -> np.ndarray:
    """Of each of n tokens, whether a sequence that holds it occurs REPEATED_TIMES in its text; known: such sequences of a text in slices."""
    if known is None:
        ordered = np.sort(grams)
        same = ordered[REPEATED_TIMES - 1 :] == ordered[: len(ordered) - REPEATED_TIMES + 1]
        known = ordered[: len(same)][same]
    hit = np.flatnonzero(np.isin(grams, known[known > 0])) if len(known) else np.zeros(0, np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + REPEATED_TOKENS, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_sequences(parts: list[str], v: Vocabulary) -> np.ndarray:
    """The sequences of tokens that occur REPEATED_TIMES in a text given in slices."""
    each = []
    for part in parts:
        cp, _ = codes.code_points([part])
        kind = codes.look(v.tables.kind, cp)
        ts, te = codes.runs((kind != codes.SPACE) & (kind != codes.BREAK))
        each.append(_grams(codes.span_hashes(codes.look(v.tables.fold, cp), ts, te), np.zeros(len(ts), np.int64)))
    values, counts = np.unique(np.concatenate(each), return_counts=True)
    return values[(counts >= REPEATED_TIMES) & (values > 0)]


def measure(texts: list[str], v: Vocabulary, known: np.ndarray | None = None) -> tuple[Units, dict[str, np.ndarray]]:
    """(units, counts per text); known: repeated_sequences() where the one text is a slice of a longer one."""
    t, n = v.tables, len(texts)
    cp, starts = codes.code_points(texts)
    kind = codes.look(t.kind, cp)
    letter, digit = (kind == codes.LOWER) | (kind == codes.UPPER) | (kind == codes.MARK), kind == codes.DIGIT
    symbol = kind == codes.SYMBOL
    inside = (kind != codes.SPACE) & (kind != codes.BREAK)
    ts, te = codes.runs(inside)  # tokens
    ls, le = codes.runs(kind != codes.BREAK)  # lines; no line spans two texts
    prefix = lambda m: np.concatenate(([0], np.cumsum(m, dtype=np.int64)))
    filled = prefix(inside)
    some = filled[le] > filled[ls]
    ls, le = ls[some], le[some]
    # units
    line = np.searchsorted(ls, ts, "right") - 1
    per_line = np.bincount(line, minlength=len(ls)) if len(ts) else np.zeros(len(ls), np.int64)
    first_token = np.concatenate(([0], np.cumsum(per_line)[:-1])) if len(ls) else np.zeros(0, np.int64)
    place = np.arange(len(ts)) - first_token[line] if len(ts) else np.zeros(0, np.int64)
    piece = np.where(per_line[line] > LONG, place // PIECE, 0) if len(ts) else place
    new_unit = np.concatenate(([True], (line[1:] != line[:-1]) | (piece[1:] != piece[:-1]))) if len(ts) else np.zeros(0, bool)
    unit = np.cumsum(new_unit) - 1
    nu = int(unit[-1]) + 1 if len(ts) else 0
    us = np.flatnonzero(new_unit)
    u_from, u_to = ts[us], te[np.append(us[1:], len(ts)) - 1] if nu else ts[us]
    u_text = np.searchsorted(starts, u_from, "right") - 1
    count = lambda m: (lambda p: p[u_to] - p[u_from])(prefix(m))
    chars, letters, digits, symbols = count(inside), count(letter), count(digit), count(symbol)
    vowels, odd = count(codes.look(t.vowel, cp) & letter), count(codes.look(v.odd, cp) & inside)
    # tokens
    said = _often(_grams(codes.span_hashes(codes.look(t.fold, cp), ts, te), np.searchsorted(starts, ts, "right") - 1), known, len(ts))
    pl, pd = prefix(letter), prefix(digit)
    tl, td = pl[te] - pl[ts], pd[te] - pd[ts]
    by_unit = lambda m: np.bincount(unit, weights=m, minlength=nu) if nu else np.zeros(0)
    tokens = by_unit(np.ones(len(ts)))
    bare = (tl == 0) & ((td > 0) | (te - ts <= 2))
    cell = by_unit(bare)
    blended = by_unit((tl > 0) & (td > 0))
    # commas, semicolons, tabs and bars inside tokens separate cells as well
    parts = count((cp == 0x2C) | (cp == 0x3B) | (cp == 9) | (cp == 0x7C))
    # words
    ws, we = codes.runs(letter)
    folded = codes.look(t.fold, cp)
    keep = np.flatnonzero(kind != codes.MARK)
    shift = prefix(kind != codes.MARK)
    h = codes.span_hashes(folded[keep], shift[ws], shift[we])
    w_unit = np.searchsorted(u_from, ws, "right") - 1
    w_text = np.searchsorted(starts, ws, "right") - 1
    common = np.isin(h, v.common)
    words = np.bincount(w_unit, minlength=nu) if len(ws) else np.zeros(nu)
    wsum = lambda m: np.bincount(w_unit, weights=m, minlength=nu) if len(ws) else np.zeros(nu)
    upper_first = kind[ws] == codes.UPPER if len(ws) else np.zeros(0, bool)
    single = (we - ws) == 1
    first = cp[u_from] if nu else np.zeros(0, np.uint32)
    last = cp[u_to - 1] if nu else first
    after = cp[np.minimum(te[us] - 1, len(cp) - 1)] if nu else first
    bracketed = (first == 0x28) & (after == 0x29)  # (a) or (12)
    numbered = ((codes.look(t.kind, first) == codes.DIGIT) & ((after == 0x2E) | (after == 0x29)) | bracketed) & (te[us] - ts[us] <= 5) if nu else np.zeros(0, bool)
    bulleted = codes.look(v.bullet, first) & (te[us] - ts[us] == 1) if nu else np.zeros(0, bool)
    marked = (numbered | bulleted | (last == 0x3B)).astype(float)
    wide = np.maximum(words, 1)
    stats = {
        "common": np.where(words > 0, wsum(common) / wide, np.where(digits > 0, 0.0, 0.1)), "digits": _share(digits, chars), "cells": np.maximum(_share(cell, tokens), np.where(digits > 0, _share(parts + cell - by_unit(bare & (td == 0)), parts + tokens), 0.0) * (digits > 3)),
        "capital": wsum(upper_first) / wide, "vowels": np.where(letters >= 8, _share(vowels, letters), 0.4), "odd": np.where((symbols > 0) & (digits * 4 < chars), _share(odd, chars), np.minimum(_share(odd, chars), 0.029)),
        "single": np.where(words >= 5, wsum(single) / wide, 0.0), "mixed": np.where(tokens >= 3, _share(blended, tokens), 0.0), "repeated": _share(by_unit(said), tokens), "signs": _share(symbols, tokens), "marked": marked,
    }
    u = Units(u_text, chars, stats)
    by_text = lambda w, idx: np.bincount(idx, weights=w, minlength=n) if len(idx) else np.zeros(n)
    l_text = np.searchsorted(starts, ls, "right") - 1
    back = np.maximum.accumulate(np.where(inside, np.arange(len(cp)), -1))
    ended = codes.look(v.ending, cp[back[le - 1]]) if len(ls) else np.zeros(0, bool)
    return u, {
        "words": by_text(np.ones(len(ws)), w_text), "lines": by_text(np.ones(len(ls)), l_text), "letters": by_text((we - ws).astype(float), w_text), "symbols": by_text(symbols, u_text), "digits": by_text(digits, u_text),
        "chars": by_text(chars, u_text), "ended": by_text(ended.astype(float), l_text), "common": by_text(common.astype(float), w_text),
    }


def emissions(u: Units) -> np.ndarray:
    """Log-likelihood of each unit under each state. Short units say less: their evidence is scaled down."""
    out = np.zeros((len(u.text), len(STATES)))
    for name, (bounds, table) in EMISSIONS.items():
        out += np.array(table)[np.searchsorted(bounds, u.stats[name], "right")]
    return out * weight(u.chars)[:, None]


def weight(chars: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, 0.1 + chars / 90)


def viterbi(e: np.ndarray, text: np.ndarray, n: int, moves: np.ndarray | None = None, begin: np.ndarray | None = None) -> np.ndarray:
    """The most likely state of each unit; all texts step together."""
    first = np.searchsorted(text, np.arange(n))
    length = np.diff(np.append(first, len(text)))
    order = np.argsort(-length, kind="stable")
    k = e.shape[1]
    move = np.array(MOVES) if moves is None else moves
    back = np.zeros((len(text), k), np.int8)
    best = np.zeros((n, k))
    label = np.zeros(len(text), np.int64)
    active = int((length > 0).sum())
    best[:active] = np.array(FIRST if begin is None else begin) + e[first[order[:active]]]
    sizes = [active]
    for step in range(1, int(length.max(initial=0))):
        active = int(np.searchsorted(-length[order], -step, "left"))
        at = first[order[:active]] + step
        scores = best[:active, :, None] + move[None]
        back[at] = scores.argmax(axis=1)
        best[:active] = scores.max(axis=1) + e[at]
        sizes.append(active)
    now = best.argmax(axis=1)
    for step in range(len(sizes) - 1, -1, -1):
        a = sizes[step]
        at = first[order[:a]] + step
        label[at] = now[:a]
        now[:a] = back[at, now[:a]] if step else now[:a]
    return label


def describe(texts: list[str | None], v: Vocabulary) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(counts, characters by label) of each text.

    Texts are measured in groups, very long ones in slices, but labelled whole: the units of all slices form one sequence,
    repetition counts over the whole text, and a line that crosses a cut counts once.
    """
    n = len(texts)
    counts: dict[str, np.ndarray] = {}
    index, chars, e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, len(STATES)))]

    def add(which: list[int], group: list[str], known: np.ndarray | None) -> None:
        u, c = measure(group, v, known)
        index.append(np.array(which, np.int64)[u.text])
        chars.append(u.chars)
        e.append(emissions(u))
        for name, x in c.items():
            np.add.at(counts.setdefault(name, np.zeros(n)), which, x)

    for which, group in codes.groups([None if t is not None and len(t) > codes.GROUP else t for t in texts]):
        add(which, group, None)
    for i in (i for i, t in enumerate(texts) if t is not None and len(t) > codes.GROUP):
        parts = list(codes.slices(texts[i]))
        known, before = repeated_sequences(parts, v), ""
        for part in parts:
            add([i], [part], known)
            tail, head = before.splitlines()[-1:], part.splitlines()[:1]
            if tail and head and codes.look(v.tables.kind, np.array([ord(before[-1])]))[0] != codes.BREAK and tail[0].strip() and head[0].strip():
                counts["lines"][i] -= 1
                counts["ended"][i] -= bool(codes.look(v.ending, np.array([ord(tail[0].rstrip()[-1])]))[0])
            before = part
    held, chars, e = np.concatenate(index), np.concatenate(chars), np.concatenate(e)
    order = np.argsort(held, kind="stable")
    labels = np.zeros((n, len(LABELS)))
    np.add.at(labels, (held[order], LABEL_OF[viterbi(e[order], held[order], n)]), chars[order])
    return counts, labels


def classes(labels: np.ndarray) -> np.ndarray:
    """prose unless more than half of the characters are labelled otherwise, then the largest of list, table and junk."""
    other = labels[:, 1:].sum(axis=1)
    return np.where(other * 2 > labels.sum(axis=1), np.array(LABELS[1:])[labels[:, 1:].argmax(axis=1)], LABELS[0])


SCHEMA = "doc_id long, n_words long, n_lines long, mean_word_length double, symbol_share double, digit_share double, ended_share double, common_share double, prose double, list double, table double, junk double, text_class string"


def statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """Per document (doc_id, text): counts and shares, label shares and text_class (see SCHEMA).

    text_class is prose unless the greater part of the characters is labelled otherwise, then the largest of list, table
    and junk. Null and blank texts have zero counts and class prose; rows without id are left out; repeated ids give one
    row each. One pass over the texts, no shuffle. Common words count in any language, since `lang` is often wrong.
    """
    words = [r.word for r in common_words.select("word").where("word is not null").distinct().limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    vocab = vocabulary(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            if not len(ids):
                continue
            c, labels = describe(texts, vocab)
            shares = labels / np.maximum(labels.sum(axis=1, keepdims=True), 1)
            cols = [
                c["words"].astype(np.int64), c["lines"].astype(np.int64), _share(c["letters"], c["words"]), _share(c["symbols"], c["chars"]), _share(c["digits"], c["chars"]), _share(c["ended"], c["lines"]), _share(c["common"], c["words"]), *shares.T,
            ]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols), pa.array(classes(labels).tolist(), pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def not_prose(stats: DataFrame) -> DataFrame:
    return stats.where("text_class <> 'prose'").select("doc_id", "text_class")
