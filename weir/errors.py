"""Errors of registration, dispatch, parsing and storage."""

from __future__ import annotations


class WeirError(Exception):
    """Base of all errors; ``code`` is stable and machine-readable."""

    code = "error"


class RegisterError(WeirError):
    code = "register"


class ParseError(RegisterError):
    code = "parse_error"


class UnsupportedSql(RegisterError):
    code = "unsupported_sql"


class UnknownTable(RegisterError):
    code = "unknown_table"


class AmbiguousTable(RegisterError):
    code = "ambiguous_table"


class UnknownColumn(RegisterError):
    code = "unknown_column"


class TypeMismatch(RegisterError):
    code = "type_error"


class CatalogError(RegisterError):
    code = "schema_catalog"


class StorageError(RegisterError):
    code = "storage"


class DispatchError(WeirError):
    code = "dispatch"


class UnknownTableId(DispatchError):
    code = "unknown_table_id"


class ArityMismatch(DispatchError):
    code = "arity_mismatch"


class MissingImage(DispatchError):
    code = "missing_image"


class AggregateUpdateRequiresOldRow(DispatchError):
    code = "aggregate_update_requires_old_row"


class TruncateRequiresReset(DispatchError):
    code = "truncate_requires_reset"


class EventBuildError(WeirError):
    code = "event_build"


class ConfigError(WeirError):
    code = "config"


class MergeError(WeirError):
    code = "merge"


#: What a change message can be rejected for (the value of ``error`` in parsed events).
PARSE_ERRORS = (
    "json",
    "utf8",
    "malformed_payload",
    "missing_field",
    "unknown_event_kind",
    "unknown_table",
    "ambiguous_table",
    "unknown_column",
    "duplicate_column",
    "invalid_column_id",
    "array_length_mismatch",
    "type_conversion",
    "missing_primary_key",
)


class WalParseError(WeirError):
    """A message of a change log that can't be parsed; ``code`` is one of ``PARSE_ERRORS``."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code
