"""Labels of documents by the shape of their lines, written apart from the operator: what the fit and its held-out test use."""

from __future__ import annotations

import re
from collections import Counter

CLASS = {"unreadable": "junk", "repetition": "junk"}
_CELL = r"(?:-|\d[\d .]*(?: ?%)?)"
_TABLE = re.compile(rf"(?:[^,;|\t\d]+?)(?:\s*[,;|\t]\s*{_CELL}){{2,}}\s*$|\S[^\d]*?(?:\s{{2,}}{_CELL}){{2,}}\s*$")
_LIST = re.compile(
    r"\s*(?:[-•*–] \S.*|\d+\. [^.]{3,60} \([^)]*\)[;.]?|\(\w{1,2}\) \w+ no\. ?\d+/\d+[;.]?|[^\W\d_]\S*, [^\W\d_]+ \([A-Z]{2,4}\)[;.]?|(?:[^\W\d_]\S*, ){2,}[^\W\d_]\S*[;.,]?)\s*$"
)
_HEADING = re.compile(r"Tagesordnung|Liste des orateurs|Members voting aye|Questions tabled|Order paper")
_MARKUP = re.compile(r"</?\w+[^>]*>|&\w+;|\{\{\w+\}\}|\[x\]|\b(?:print|cookie|Login|share|Home)\b")
_BROKEN = re.compile(r"[ÃÂâ€�ï¿½™©¶¤]")
_PARTS = re.compile(r"(?<=[;.]) (?=\d+\. |[-•] |\(\w\) )|(?<=;) ")


def line_label(line: str) -> str:
    words = re.findall(r"[^\W\d_]+", line)
    solid = re.sub(r"\s", "", line)
    tokens = line.split()
    if len(tokens) >= 12 and len(set(tokens[2:])) <= 4:
        return "repetition"
    if _TABLE.match(line):
        return "table"
    if _HEADING.fullmatch(line.strip()) or _LIST.match(line):
        return "list"
    if re.fullmatch(r"\s*(?:[0-9a-f]{4}\s*){4,}", line) or len(_BROKEN.findall(line)) > 0.15 * len(solid) or sum(len(m) for m in _MARKUP.findall(line)) > 0.4 * len(solid):
        return "unreadable"
    if sum(c.isalnum() for c in solid) < 0.5 * len(solid) and len(solid) > 12:
        return "unreadable"
    if len(words) >= 6 and sum(len(w) == 1 for w in words) > 0.6 * len(words):
        return "unreadable"
    if len(words) >= 5 and sum(not re.search("[aeiouyäöüéèà]", w, re.IGNORECASE) for w in words) > 0.6 * len(words):
        return "unreadable"
    return "prose"


def label(text: str | None) -> str:
    """The state (quality.STATES) of most characters, prose unless the others hold more than half."""
    held: Counter = Counter()
    for line in (text or "").splitlines():
        parts = _PARTS.split(line) if len(line) > 150 else [line]
        parts = parts if len(parts) > 5 else [line]
        for p in parts:
            held[line_label(p)] += len(re.sub(r"\s", "", p))
    other = {k: n for k, n in held.items() if k != "prose"}
    return max(other, key=other.get) if sum(other.values()) * 2 > sum(held.values()) else "prose"
