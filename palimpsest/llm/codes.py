"""Texts as arrays of code points: classes, words and word hashes of many texts at once, by whole-array operations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Character classes.
SYMBOL, LOWER, UPPER, DIGIT, SPACE, BREAK, MARK = range(7)
#: Texts are worked on in groups of about this many characters, which bounds a worker's memory; longer texts are cut into slices.
GROUP = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Tables:
    """Per code point of the basic plane (the last entry stands for all others): class, folded letter or digit (0: none), vowel."""

    kind: np.ndarray
    fold: np.ndarray
    vowel: np.ndarray


def tables() -> Tables:
    kind, fold, vowel = np.zeros(65_536, np.uint8), np.zeros(65_536, np.uint16), np.zeros(65_536, bool)
    for c in range(65_536):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] == "L":
            kind[c] = UPPER if cat in ("Lu", "Lt") else LOWER
        elif cat[0] == "N":
            kind[c] = DIGIT
        elif cat[0] == "M" or ch == "­":
            kind[c] = MARK
        elif ch in "\n\r\x85  ":
            kind[c] = BREAK
        elif ch.isspace():
            kind[c] = SPACE
        if cat[0] in "LN":
            base = unicodedata.normalize("NFKD", ch).casefold()[:1]
            fold[c] = ord(base) if base and ord(base) < 65_536 else c
            vowel[c] = base in tuple("aeiouyæøœ")
    return Tables(kind, fold, vowel)


def slices(text: str, overlap: int = 0) -> Iterator[str]:
    """A text in slices of at most GROUP characters, cut after a line break or else white space; each begins `overlap` characters before its cut."""
    at = 0
    while True:
        end = at + GROUP
        if end >= len(text):
            yield text[at:]
            return
        cut = max(text.rfind("\n", at + GROUP // 2, end), 0) or max(text.rfind(" ", at + GROUP // 2, end), 0) or end - 1
        yield text[at : cut + 1]
        at = max(cut + 1 - overlap, at + 1)


def groups(texts: list[str | None], overlap: int = 0) -> Iterator[tuple[list[int], list[str]]]:
    """(indices, texts) of groups of about GROUP characters; null counts as empty, longer texts come in slices."""
    index, held, size = [], [], 0
    for i, t in enumerate(texts):
        for part in slices(t or "", overlap):
            if held and size + len(part) > GROUP:
                yield index, held
                index, held, size = [], [], 0
            index.append(i)
            held.append(part)
            size += len(part) + 1
    if held:
        yield index, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts): the texts, each followed by a line break, as one array; starts has one entry more than there are texts."""
    joined = "\n".join(texts) + "\n" if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return codes, np.concatenate(([0], np.cumsum(lengths)))


def look(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, 65_535)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and _BASE^-i modulo 2^64 for i < n."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX
        return x ^ (x >> np.uint64(27))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on its code points only, not on its place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass(frozen=True)
class Words:
    """The words of texts, folded (case, accents, layout and hyphenation at breaks do not matter)."""

    codes: np.ndarray  # folded code points, 0 between words
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # index of the text of each word
    hashes: np.ndarray

    def word(self, i: int) -> str:
        return self.codes[self.starts[i] : self.ends[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def folded_words(texts: list[str], t: Tables) -> Words:
    codes, starts = code_points(texts)
    kind = look(t.kind, codes)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    keep = kind != MARK
    # a hyphen between letters, followed by white space, is layout: both go
    letter = (kind == LOWER) | (kind == UPPER)
    hyphen = np.flatnonzero(np.isin(codes, (0x2D, 0x2010, 0x2011, 0xAC)))
    hyphen = hyphen[(hyphen > 0) & (hyphen < len(codes) - 2)]
    hyphen = hyphen[letter[hyphen - 1] & ((kind[hyphen + 1] == SPACE) | (kind[hyphen + 1] == BREAK))]
    for h in hyphen:
        e = h + 1
        while e < min(h + 8, len(codes)) and kind[e] in (SPACE, BREAK):
            e += 1
        if e < len(codes) and kind[e] == LOWER and owner[e] == owner[h]:
            keep[h:e] = False
    # apostrophes inside words go as well
    inner = np.flatnonzero(np.isin(codes, (0x27, 0x2019, 0x2BC, 0x60, 0xB4)))
    inner = inner[(inner > 0) & (inner < len(codes) - 1)]
    keep[inner[letter[inner - 1] & letter[inner + 1]]] = False
    folded, owner = look(t.fold, codes)[keep], owner[keep]
    # the break after each text stays in, so no word spans two texts
    s, e = runs(folded > 0)
    return Words(folded, s, e, owner[s] if len(s) else owner[:0], span_hashes(folded, s, e))
