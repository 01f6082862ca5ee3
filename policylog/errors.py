"""Result codes, diagnostics and exceptions."""

from __future__ import annotations

import enum
from dataclasses import dataclass


class Code(enum.IntEnum):
    # Result codes.
    OK = 0
    INVALID_ARGUMENT = -1
    INVALID_FIELD = -2
    NOT_FOUND = -3
    NOT_IMPLEMENTED = -4
    UNSUPPORTED = -5
    TIMEOUT = -6
    IO = -7
    INTERNAL = -8
    UNAUTHORIZED = -9
    FORBIDDEN = -10
    RATE_LIMITED = -11
    PAYLOAD_TOO_LARGE = -12
    INVALID_STATE = -13


# Diagnostic names.
DIAGNOSTICS = (
    "NONE",
    "MANIFEST_INVALID_JSON",
    "MANIFEST_INVALID_FIELD",
    "MANIFEST_UNKNOWN_FIELD",
    "MANIFEST_UNKNOWN_DOMAIN",
    "MANIFEST_SHA_MISMATCH",
    "MANIFEST_POLICY_NOT_FOUND",
    "MANIFEST_TEST_ONLY_REJECTED",
    "LEXER_INVALID_TOKEN",
    "LEXER_UNSUPPORTED_CONSTRUCT",
    "LEXER_INVALID_UTF8",
    "LEXER_STRING_TOO_LONG",
    "PARSER_EXPECTED_PREDICATE",
    "PARSER_UNKNOWN_PREDICATE",
    "PARSER_ARITY_MISMATCH",
    "PARSER_UNKNOWN_ATOM",
    "PARSER_RULE_HEAD_EDB_FORBIDDEN",
    "PARSER_RULE_BODY_LITERAL_OVERFLOW",
    "PARSER_UNSAFE_VARIABLE",
    "PARSER_INVALID_COMPARISON",
    "PARSER_EXPECTED_DOT",
    "PARSER_EXPECTED_NECK",
    "PARSER_FACT_USES_NON_BASE_PREDICATE",
    "PARSER_ANONYMOUS_VARIABLE_IN_HEAD",
    "PARSER_ANONYMOUS_VARIABLE_IN_COMPARISON",
    "PARSER_ANONYMOUS_VARIABLE_IN_FACT",
    "PARSER_TOO_MANY_VARIABLES",
    "POLICY_NOT_STRATIFIABLE",
    "RUNTIME_INVALID_COMPARISON",
    "REGISTRY_CONFLICT",
    "REGISTRY_MUTATION_AFTER_FREEZE",
)
# Categories of a failed solve.
CATEGORIES = ("none", "max_depth", "idb_overflow", "comparison_type_error", "malformed_fact", "malformed_edb", "invalid_state", "invalid_argument", "internal_error")


@dataclass(frozen=True)
class Diagnostic:
    code: str = "NONE"
    phase: str = ""
    message: str = ""
    hint: str = ""
    file: str | None = None
    line: int = 0
    column: int = 0
    token: str = ""
    predicate: str = ""
    arity: int | None = None
    field: str = ""
    domain: str = ""
    count: int | None = None
    limit: int | None = None


class DatalogError(Exception):
    """Any refusal: a result code, a message, a hint, and where there is one, a diagnostic or a solve category."""

    def __init__(self, code: Code, message: str, hint: str = "", diagnostic: Diagnostic | None = None, category: str = "none", deny_reason: str = "DENY_NONE"):
        super().__init__(f"{message} ({code.name})" + (f": {hint}" if hint else ""))
        self.code, self.message, self.hint, self.category, self.deny_reason = code, message, hint, category, deny_reason
        self.diagnostic = diagnostic or Diagnostic()


class DomainAlreadyRegisteredError(DatalogError):
    pass


class DomainRegistryFullError(DatalogError):
    pass


def refuse(code: Code, diagnostic: str, phase: str, message: str, hint: str = "", **where) -> DatalogError:
    return DatalogError(code, message, hint, Diagnostic(diagnostic, phase, message, hint, **where))
