"""Typed failures: class, code and whether a retry can help."""

from __future__ import annotations


class StoreError(Exception):
    kind, code, retryable = "internal", "unclassified", False


class InvalidInput(StoreError):
    kind, code = "validation", "invalid_input"


class InvalidBranchName(InvalidInput):
    code = "invalid_branch_name"


class SecretDetected(InvalidInput):
    code = "secret_detected"


class AmbiguousBlob(InvalidInput):
    code = "ambiguous_blob"


class AddressOccupied(InvalidInput):
    code = "address_occupied"


class InvalidIdentifier(InvalidInput):
    code = "invalid_identifier"


class ApprovalRefused(InvalidInput):
    code = "approval_required"

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class NotFound(StoreError):
    kind, code = "not_found", "ref_not_found"


class ObjectNotFound(NotFound):
    code = "object_not_found"


class RowNotFound(NotFound):
    code = "row_not_found"


class StorageFailure(StoreError):
    kind, code, retryable = "storage", "io_failure", True


class ObjectKindMismatch(StoreError):
    kind, code = "storage", "object_kind_mismatch"


class SegmentRowCorrupt(StoreError):
    kind, code = "storage", "segment_row_corrupt"


class IntegrityFailure(StoreError):
    kind, code = "storage", "object_integrity_failure"


class SchemaMismatch(StoreError):
    kind, code = "memory", "schema_mismatch"


class BackendFailure(StoreError):
    kind, code, retryable = "memory", "backend_failure", True


class BackendMisconfigured(StoreError):
    kind, code = "memory", "backend_misconfigured"


class CaptureDead(StoreError):
    kind, code = "memory", "streamer_dead"


class MissingReverseMigration(StoreError):
    kind, code = "memory", "missing_reverse_migration"


class Busy(StoreError):
    kind, code, retryable = "concurrency", "writer_active", True


#: Words in the message of a foreign error, and the class, code and retry that they stand for; the first that fits counts.
FOREIGN = (
    ("no key in segment", ("storage", "segment_row_corrupt", False)),
    ("unknown op in segment", ("storage", "segment_row_corrupt", False)),
    ("null primary key", ("validation", "invalid_input", False)),
    ("non-finite value", ("validation", "invalid_input", False)),
    ("BadChange", ("memory", "streamer_dead", False)),
    ("Connection refused", ("memory", "postgres_pool_unavailable", True)),
    ("No space left", ("storage", "io_failure", True)),
    ("Permission denied", ("storage", "io_failure", True)),
    ("PATH_NOT_FOUND", ("not_found", "object_not_found", False)),
    ("UNRESOLVED_COLUMN", ("memory", "postgres_schema_drift", False)),
)


def classify(error: BaseException) -> tuple[str, str, bool]:
    """(class, code, retryable) of any failure; the innermost typed one along its causes counts, then words of foreign messages."""
    seen, at = [], error
    while at is not None and at not in seen:
        seen.append(at)
        at = at.__cause__ or at.__context__
    for e in reversed(seen):
        if isinstance(e, StoreError):
            return e.kind, e.code, e.retryable
    for e in seen:
        for words, answer in FOREIGN:
            if words in str(e):
                return answer
    for e in seen:
        if isinstance(e, (TimeoutError, OSError)):
            return "storage", "io_failure", True
        if isinstance(e, ValueError):
            return "storage", "serialization_failure", False
    return "internal", "unclassified", False
