"""Approval tokens for destructive rollbacks: HMAC-SHA256 over scope, commit, user and time."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field

from .errors import ApprovalRefused

#: Fixed value: seconds a token may differ from the clock, either way.
TTL_SECONDS = 300
SCOPES = {"data_loss": "palimpsest/rollback/v1", "reverse_migration": "palimpsest/rollback/v1/reverse-migration"}


def _tag(key: bytes, scope: str, commit: str, uid: int, at: int) -> bytes:
    return hmac.new(key, f"{SCOPES[scope]}:{commit.lower()}:{uid}:{at}".encode(), hashlib.sha256).digest()


def issue(key: bytes, scope: str, commit: str, uid: int, now: int) -> str:
    return f"{now}:{_tag(key, scope, commit, uid, now).hex()}"


def verify(key: bytes, scopes: tuple[str, ...], commit: str, uid: int, token: str, now: int) -> tuple[str, bytes, int]:
    """(scope, tag, time) of a valid token; the time is checked before the tag, the tag in constant time."""
    at_text, colon, tag_text = token.partition(":")
    try:
        at, tag = int(at_text), bytes.fromhex(tag_text)
    except ValueError:
        raise ApprovalRefused("approval_token_malformed") from None
    if not colon or at < 0 or len(tag) != 32:
        raise ApprovalRefused("approval_token_malformed")
    if abs(now - at) > TTL_SECONDS:
        raise ApprovalRefused("approval_token_expired")
    for scope in scopes:
        if hmac.compare_digest(tag, _tag(key, scope, commit, uid, at)):
            return scope, tag, at
    raise ApprovalRefused("approval_token_invalid_signature")


@dataclass
class Gate:
    """Fails closed; each token is good for one rollback; a dry run verifies without using it up. Every decision is audited."""

    key: bytes | None
    used: dict[bytes, int] = field(default_factory=dict)
    audit: list[tuple[str, str]] = field(default_factory=list)

    def check(self, commit: str, uid: int | None, token: str | None, data_loss: bool, now: int, dry_run: bool = False) -> None:
        try:
            if self.key is None:
                raise ApprovalRefused("approval_key_not_configured")
            if uid is None:
                raise ApprovalRefused("approval_no_peer_uid")
            if token is None:
                raise ApprovalRefused("approval_required")
            scopes = ("data_loss",) if data_loss else ("reverse_migration", "data_loss")
            _, tag, at = verify(self.key, scopes, commit, uid, token, now)
            self.used = {t: e for t, e in self.used.items() if e >= now}
            if tag in self.used:
                raise ApprovalRefused("approval_token_replayed")
            if not dry_run:
                self.used[tag] = at + TTL_SECONDS
        except ApprovalRefused as e:
            self.audit.append((e.code, (token or "").partition(":")[2][:8] or (token or "")[:8]))
            raise
        self.audit.append(("accepted", token.partition(":")[2][:8]))
