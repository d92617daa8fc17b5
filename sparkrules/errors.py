"""Errors with a code and the place they come from."""

from __future__ import annotations

CODES = frozenset(
    """YAML_SYNTAX_ERROR MISSING_REQUIRED_FIELD UNKNOWN_FIELD_NAME TYPE_MISMATCH DUPLICATE_RULE_ID SCHEMA_MISMATCH
    INCOMPATIBLE_PARQUET_SCHEMA MALFORMED_JSON JSON_CAPACITY_EXCEEDED FIELD_TYPE_COERCION_FAILED ARENA_EXHAUSTED
    KERNEL_COLUMN_INDEX_OOB INVALID_ENGINE_CONFIG UNKNOWN_OP UNKNOWN_ACTION UNKNOWN_SEVERITY FILE_IO_ERROR
    HOT_RELOAD_FAILED DEAD_LETTER_WRITE_FAILED INTERNAL_ERROR""".split()
)


class RuleEngineError(Exception):
    """Base class; ``code`` is one of CODES."""

    domain = "INTERNAL"

    def __init__(self, code: str, message: str, *, rule_id: str = "", field: str = "", source: str = ""):
        assert code in CODES, code
        super().__init__(f"{code}: {message}" + (f" (rule {rule_id})" if rule_id else ""))
        self.code, self.message, self.rule_id, self.field, self.source = code, message, rule_id, field, source


class ConfigError(RuleEngineError):
    domain = "CONFIG"


class ParseError(RuleEngineError):
    domain = "RULE_PARSE"


class SchemaError(RuleEngineError):
    domain = "SCHEMA"


class LookupLoadError(RuleEngineError):
    domain = "LOOKUP"


class IngestError(RuleEngineError):
    domain = "INGEST"
