"""Trigram index over chunks of texts: postings of the trigrams that regexes require, and their intersection.

The index is partitioned by text: all trigrams of a chunk are where the chunk is, so postings are built, intersected and
used within the task that holds the texts, and nothing of the index is shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np

from .patterns import required

#: Texts are indexed in chunks of this many characters.
CHUNK = 65_536
#: Chunks are indexed in groups of about this many characters, which bounds a worker's memory.
GROUP = 1_000_000
_BETWEEN = "\uffff"  # no character; stands between chunks


def _grams(s: str) -> set[str]:
    return {s[i : i + 3] for i in range(len(s) - 2)}


class Rules:
    """The regexes (case ignored) of an index: required trigrams, numbered, and the alternatives of each rule.

    `number` gives each code point the number of the character of a required string that it equals when case is ignored,
    by the regex engine's own account (so the long s counts as s), or 0.
    """

    def __init__(self, patterns: dict[str, str]) -> None:
        needs = {name: required(p) for name, p in patterns.items()}
        alphabet = sorted({c for alts in needs.values() for a in alts for c in a})
        if len(alphabet) > 63:
            raise ValueError("more than 63 characters in required strings")
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0xFFFF)]))
        self.number = np.zeros(65_536, np.int64)
        for k, c in enumerate(alphabet, 1):
            self.number[[ord(x) for x in re.findall(re.escape(c), plane, re.IGNORECASE)]] = k
        code = lambda g: reduce(lambda a, c: a * 64 + self.number[ord(c)], g, 0)
        grams = sorted({int(code(g)) for alts in needs.values() for a in alts for g in _grams(a)})
        self.gram = np.full(1 << 18, -1, np.int32)
        self.gram[grams] = np.arange(len(grams))
        self.count = len(grams)
        self.alternatives = {name: [np.unique([self.gram[code(g)] for g in _grams(a)]) for a in alts] for name, alts in needs.items()}
        #: Chunks see this many characters after their end, so that each required string lies within one.
        self.overlap = max((len(a) for alts in needs.values() for a in alts), default=1) - 1


def postings(chunks: list[str], rules: Rules) -> list[np.ndarray]:
    """The index: of each required trigram the chunks that hold it, in order."""
    codes = np.frombuffer(_BETWEEN.join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = rules.number[np.minimum(codes, 65_535)]
    gram = rules.gram[np.where((n[:-2] > 0) & (n[1:-1] > 0) & (n[2:] > 0), n[:-2] * 4096 + n[1:-1] * 64 + n[2:], 0)] if len(n) > 2 else np.zeros(0, np.int32)
    at = np.flatnonzero(gram >= 0)
    starts = np.cumsum([0, *(len(c) + 1 for c in chunks)])
    held = np.unique(gram[at].astype(np.int64) * len(chunks) + np.searchsorted(starts, at, "right") - 1)
    which, chunk = np.divmod(held, max(len(chunks), 1))
    return np.split(chunk, np.searchsorted(which, np.arange(1, rules.count)))


def candidates(posted: list[np.ndarray], rules: Rules) -> dict[str, np.ndarray]:
    """Per rule the chunks that hold all trigrams of one of its alternatives: postings intersected, the shortest first."""
    out = {}
    for name, alts in rules.alternatives.items():
        met = [reduce(lambda a, b: a[np.isin(a, b, assume_unique=True)] if len(a) else a, sorted((posted[g] for g in alt), key=len)) for alt in alts]
        out[name] = np.unique(np.concatenate(met))
    return out


def candidate_rules(texts: list[str], rules: Rules) -> list[tuple[int, list[str]]]:
    """(text, rules) of the texts of which any chunk is a candidate of a rule."""
    met: dict[int, set[str]] = {}

    def index(owner: list[int], chunks: list[str]) -> None:
        for name, found in candidates(postings(chunks, rules), rules).items():
            for c in found:
                met.setdefault(owner[c], set()).add(name)

    owner, chunks, size = [], [], 0
    for i, text in enumerate(texts):
        for lo in range(0, len(text), CHUNK):
            chunks.append(text[lo : lo + CHUNK + rules.overlap])
            owner.append(i)
            size += len(chunks[-1])
            if size >= GROUP:
                index(owner, chunks)
                owner, chunks, size = [], [], 0
    if chunks:
        index(owner, chunks)
    return [(i, sorted(names)) for i, names in sorted(met.items())]
