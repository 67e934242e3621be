"""Tool manifests of servers: fetched under limits, several at a time, fingerprinted by their canonical JSON."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import urlsplit

from ..errors import InvalidInput
from ..functions.documents import canonical_text, depth_of

# Limits of a fetch, and the request.
TIMEOUT_SECONDS, MOST_BODY_BYTES, MOST_DEPTH, MOST_MANIFEST_BYTES, AT_ONCE = 10, 2**20, 32, 2**20, 8
REQUEST = {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}


@dataclass(frozen=True)
class Manifest:
    """Canonical text of a server's tools and its hash, or the failure in their place."""

    name: str
    text: str | None = None
    hash: str | None = None
    failure: str | None = None


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args: object) -> None:
        return None


def parse_spec(items: list[str]) -> list[tuple[str, str]]:
    """(name, url) of name=url items; https anywhere, http on loopback only, no name twice."""
    out: list[tuple[str, str]] = []
    for item in items:
        name, eq, url = item.partition("=")
        parts = urlsplit(url)
        local = parts.hostname in ("localhost", "::1") or (parts.hostname or "").startswith("127.")
        if not eq or not name or name in dict(out) or not parts.hostname or not (parts.scheme == "https" or (parts.scheme == "http" and local)):
            raise InvalidInput(f"server {item!r}")
        out.append((name, url))
    return out


def post(url: str) -> bytes:
    """Body of the answer to REQUEST; refused beyond MOST_BODY_BYTES, declared or read."""
    ask = urllib.request.Request(url, json.dumps(REQUEST).encode(), {"Content-Type": "application/json"})
    with urllib.request.build_opener(_NoRedirects, urllib.request.ProxyHandler({})).open(ask, timeout=TIMEOUT_SECONDS) as answer:
        if int(answer.headers.get("Content-Length") or 0) > MOST_BODY_BYTES:
            raise InvalidInput("body too large")
        body = answer.read(MOST_BODY_BYTES + 1)
    if len(body) > MOST_BODY_BYTES:
        raise InvalidInput("body too large")
    return body


def fingerprint(name: str, url: str, fetch: Callable[[str], bytes] = post) -> Manifest:
    """The tools a server lists, as canonical JSON; anything else is a failure of that server alone."""
    try:
        answer = json.loads(fetch(url))
        if not isinstance(answer, dict) or "result" not in answer:
            raise InvalidInput("no result")
        text = json.dumps(answer["result"])
        if (depth_of(text) or 0) > MOST_DEPTH:
            raise InvalidInput("manifest too deep")
        text = canonical_text(text) or ""
        if len(text.encode()) > MOST_MANIFEST_BYTES:
            raise InvalidInput("manifest too large")
    except (OSError, ValueError, RecursionError, InvalidInput, urllib.error.URLError) as e:
        return Manifest(name, failure=str(e))
    return Manifest(name, text, sha256(text.encode()).hexdigest())


def fingerprint_all(servers: list[tuple[str, str]], fetch: Callable[[str], bytes] = post) -> list[Manifest]:
    """Of each server, in the order given, at most AT_ONCE at a time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(lambda s: fingerprint(*s, fetch), servers))
