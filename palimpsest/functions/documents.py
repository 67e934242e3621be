"""JSON documents: canonical text, depth; thread names and checkpoint envelopes (vectorised Python)."""

from __future__ import annotations

import base64
import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Version and payload types of a checkpoint envelope.
ENVELOPE_VERSION = 1
ENVELOPE_TYPES = ("bytearray", "bytes", "msgpack", "null")


class Number(str):
    """A JSON number kept as it is spelled."""


def canonical_text(text: str | None) -> str | None:
    """Keys sorted at every depth, arrays and the spelling of numbers kept, no white space; null where the text is no JSON."""
    if text is None:
        return None
    try:
        x = json.loads(text, parse_float=Number, parse_int=Number, parse_constant=Number)
    except (ValueError, RecursionError):
        return None

    def put(v: object) -> str:
        if isinstance(v, Number):
            return str.__str__(v)
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{put(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(put, v)) + "]"
        return json.dumps(v, ensure_ascii=False)

    return put(x)


def depth_of(text: str | None) -> int | None:
    """1 for a scalar and an empty array or object, one more per level."""
    try:
        x = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if text is None:
        return None
    level, depth = [x], 0
    while level:
        depth += 1
        level = [v for y in level if isinstance(y, (dict, list)) for v in (y.values() if isinstance(y, dict) else y)]
    return depth


def branch_of_thread(thread: str) -> str:
    return "thread/" + hashlib.blake2b(thread.encode(), digest_size=8).hexdigest()


def encode_checkpoint(thread: str, checkpoint: tuple[str, bytes], metadata: tuple[str, bytes]) -> str:
    part = lambda p: {"type": p[0], "data_b64": base64.b64encode(p[1]).decode()}
    return json.dumps({"v": ENVELOPE_VERSION, "thread_id": thread, "checkpoint": part(checkpoint), "metadata": part(metadata)})


def decode_checkpoint(text: str) -> tuple[tuple[str, bytes], tuple[str, bytes]]:
    """The two typed payloads; any other version or type is refused before it is decoded."""
    x = json.loads(text)
    if x.get("v") != ENVELOPE_VERSION:
        raise ValueError(f"unsupported envelope version {x.get('v')!r}")
    out = []
    for name in ("checkpoint", "metadata"):
        if x[name]["type"] not in ENVELOPE_TYPES:
            raise ValueError(f"unsupported payload type {x[name]['type']!r}")
        out.append((x[name]["type"], base64.b64decode(x[name]["data_b64"])))
    return out[0], out[1]


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    return s.map(canonical_text, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def json_depth(s: pd.Series) -> pd.Series:
    return s.map(depth_of).astype("Int32")


@F.pandas_udf(T.StringType())
def thread_branch(s: pd.Series) -> pd.Series:
    return s.map(branch_of_thread, na_action="ignore")
