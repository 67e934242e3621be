"""JSON by value: one spelling per value, as text, hash and kind (Python side, on Arrow batches)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

from xxhash import xxh3_64_intdigest

_INTEGER, _NUMBER = re.compile(r"-?(0|[1-9][0-9]*)"), re.compile(r"[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]{1,3})?")
_PLACES, _EXACT = Decimal(1).scaleb(-12), Context(prec=60)


def number(x: float) -> int | float:
    return int(x) if isinstance(x, float) and x.is_integer() else x


def settle(x: object) -> object:
    """Numbers in one spelling, absent fields for null ones, at every depth."""
    if isinstance(x, dict):
        return {k: settle(v) for k, v in x.items() if v is not None}
    if isinstance(x, list):
        return [settle(v) for v in x]
    return number(x) if isinstance(x, float) else x


_dumps = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def canonical(x: object) -> str:
    return _dumps(settle(x))


def value_hash(x: object) -> int:
    """Hash by value of what an object_reader() gave."""
    h = xxh3_64_intdigest(_dumps(x).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def plain(key: object) -> str | None:
    """Plain text of a key; the same as functions.keys.plain_key() gives for columns."""
    if key is None or isinstance(key, (dict, list)):
        return None
    if isinstance(key, bool):
        return "true" if key else "false"
    if isinstance(key, int):
        return str(key)
    text = key if isinstance(key, str) else repr(key)
    t = text.strip(" ")
    if not t:
        return None
    if _INTEGER.fullmatch(t):
        return t
    if not _NUMBER.fullmatch(t):
        return text
    d = Decimal(t)
    if d.adjusted() > 25:  # beyond decimal(38, 12)
        return text
    d = d.quantize(_PLACES, ROUND_HALF_UP, _EXACT)
    return format(d, "f").rstrip("0").rstrip(".") if d else "0"


def _without_nulls(pairs: list[tuple[str, object]]) -> dict:
    return {k: v for k, v in pairs if v is not None}


def object_reader() -> Callable[[str | None], dict | None]:
    """A function from JSON texts to their objects, settled while they are read; None for a text that is no object."""
    decode = json.JSONDecoder(parse_float=lambda s: number(float(s)), object_pairs_hook=_without_nulls).decode

    def read(text: str | None) -> dict | None:
        try:
            x = decode(text) if text else None
        except (ValueError, RecursionError):
            return None
        return x if isinstance(x, dict) else None

    return read


def envelope(x: dict) -> tuple[str, dict | None]:
    """(op, row): both parts of an envelope, or an insert of the bare row."""
    if isinstance(x.get("row"), dict) and isinstance(x.get("op"), str):
        return x["op"].strip().lower(), x["row"]
    return "insert", x
