"""What a regex requires of a text: a small reader of the syntax the rules use, and the strings of which one must occur."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

#: Most alternative strings that are followed through a regex before a weaker condition is taken.
MOST_STRINGS = 4_096
#: Largest class whose members are followed one by one.
MOST_MEMBERS = 8
_ENDLESS = 1 << 30


@dataclass
class Node:
    """chars: one of these characters (None: any of a large class); seq, alt: of nodes; repeat: of one node; empty: matches nothing wide."""

    kind: str
    chars: frozenset[str] | None = None
    parts: list[Node] = field(default_factory=list)
    low: int = 1
    high: int = 1


class _Reader:
    """Literals, escapes, classes, groups (named, uncaptured, with flags), look-around, alternation, repetition of any greed."""

    def __init__(self, pattern: str) -> None:
        self.p, self.at = pattern, 0

    def peek(self, s: str) -> bool:
        return self.p.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def alternatives(self) -> Node:
        branches = [self.sequence()]
        while self.take("|"):
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else Node("alt", parts=branches)

    def sequence(self) -> Node:
        parts = []
        while self.at < len(self.p) and not self.peek("|") and not self.peek(")"):
            parts.append(self.repeated(self.atom()))
        return Node("seq", parts=parts)

    def repeated(self, node: Node) -> Node:
        while self.at < len(self.p):
            if self.take("*"):
                low, high = 0, _ENDLESS
            elif self.take("+"):
                low, high = 1, _ENDLESS
            elif self.take("?"):
                low, high = 0, 1
            elif self.peek("{") and self.p[self.at + 1].isdigit():
                end = self.p.index("}", self.at)
                first, comma, last = self.p[self.at + 1 : end].partition(",")
                low, high, self.at = int(first), int(last) if last else _ENDLESS if comma else int(first), end + 1
            else:
                break
            self.take("?") or self.take("+")
            node = Node("repeat", parts=[node], low=low, high=high)
        return node

    def atom(self) -> Node:
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.members()
        if c in "^$":
            return Node("empty")
        if c == ".":
            return Node("chars")
        if c == "\\":
            return self.escape()
        return Node("chars", frozenset(c.lower()))

    def escape(self) -> Node:
        c = self.p[self.at]
        self.at += 1
        if c in "bBAZ":
            return Node("empty")
        if c in "sSdDwW":
            return Node("chars")
        return Node("chars", frozenset({"n": "\n", "r": "\r", "t": "\t"}.get(c, c.lower())))

    def group(self) -> Node:
        look = any(self.take(s) for s in ("?<!", "?<=", "?!", "?="))
        if not look and self.take("?P<"):
            self.at = self.p.index(">", self.at) + 1
        elif not look and self.take("?"):
            self.at = self.p.index(":", self.at) + 1  # flags, none of which makes it match more
        inner = self.alternatives()
        if not self.take(")"):
            raise ValueError(f"no end of a group in {self.p!r}")
        return Node("empty") if look else inner

    def members(self) -> Node:
        out: set[str] | None = None if self.take("^") else set()
        first = True
        while first or not self.peek("]"):
            first = False
            c = self.p[self.at]
            self.at += 1
            one = self.escape().chars if c == "\\" else frozenset(c)
            if self.peek("-") and self.p[self.at + 1] != "]":
                self.at += 1
                last = self.p[self.at]
                self.at += 1
                one = frozenset(map(chr, range(ord(next(iter(one))), ord(last) + 1))) if one else None
            out = None if out is None or one is None else out | {x.lower() for x in one}
        self.at += 1
        return Node("chars", frozenset(out) if out is not None and len(out) <= MOST_MEMBERS else None)


def read(pattern: str) -> Node:
    reader = _Reader(pattern)
    node = reader.alternatives()
    if reader.at != len(pattern):
        raise ValueError(f"cannot read {pattern!r} from {reader.at} on")
    return node


def _weight(alternatives: set[str]) -> int:
    return min(map(len, alternatives), default=0)


def conditions(node: Node) -> tuple[set[str] | None, list[set[str]]]:
    """(strings, conditions): all strings the node matches if they are few, else None; sets of strings of which one must occur."""
    if node.kind == "empty":
        return {""}, []
    if node.kind == "chars":
        return (set(node.chars), []) if node.chars else (None, [])
    if node.kind == "alt":
        each = [conditions(p) for p in node.parts]
        if all(s is not None for s, _ in each):
            return set().union(*(s for s, _ in each)), []
        best = [s if s is not None else max(c, key=_weight, default=set()) for s, c in each]
        return None, [set().union(*best)] if all(_weight(b) >= 3 for b in best) else []
    if node.kind == "repeat":
        strings, more = conditions(node.parts[0])
        if strings is not None and node.low == 0 and node.high == 1:
            return strings | {""}, []
        if strings is not None and len(strings) == 1 and node.low == node.high < 64:
            return {next(iter(strings)) * node.low}, []
        return None, [] if not node.low else more if strings is None else [strings]
    out: list[set[str]] = []
    run, whole = {""}, True
    for part in node.parts:
        strings, more = conditions(part)
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            out += [run, *more]
            run, whole = (strings if strings is not None and len(strings) <= MOST_STRINGS else {""}), False
        else:
            run = {a + b for a, b in product(run, strings)}
    return (run, []) if whole else (None, [*out, run])


def required(pattern: str) -> list[str]:
    """Strings (lower case) of which one occurs in each match, case ignored: the longest condition that the regex puts.

    A regex that requires no three characters in a row is refused: it would make every chunk a candidate.
    """
    strings, found = conditions(read(pattern))
    best = max([*found, *([strings] if strings else [])], key=_weight, default=set())
    if _weight(best) < 3:
        raise ValueError(f"no required trigram in {pattern!r}")
    return sorted(a for a in best if not any(b != a and b in a for b in best))  # a part of it covers it
