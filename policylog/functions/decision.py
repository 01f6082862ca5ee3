"""The decision helper: deny over reduce over allow; a deny together with either of the others is a conflict."""

from __future__ import annotations

import enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Decision(enum.IntEnum):
    # Decisions and their numbers.
    DENY = 0
    ALLOW = 1
    REDUCED = 2
    DENY_DEFAULT = 3
    DENY_CONFLICT = 4

    @property
    def text(self) -> str:
        return self.name.lower()


def decide(deny: bool, reduce: bool, allow: bool) -> Decision:
    if deny:
        return Decision.DENY_CONFLICT if reduce or allow else Decision.DENY
    if reduce:
        return Decision.REDUCED
    return Decision.ALLOW if allow else Decision.DENY_DEFAULT


def decision_column(deny: Column, reduce: Column, allow: Column) -> Column:
    """decide() over three boolean columns, as the decision's name; a null counts as not derived."""
    deny, reduce, allow = (F.coalesce(c, F.lit(False)) for c in (deny, reduce, allow))
    return (F.when(deny & (reduce | allow), Decision.DENY_CONFLICT.text).when(deny, Decision.DENY.text)
            .when(reduce, Decision.REDUCED.text).when(allow, Decision.ALLOW.text).otherwise(Decision.DENY_DEFAULT.text))


# Names of reasons to deny. A comparison error has no name of its own and prints as none.
DENY_REASONS = ("DENY_NONE", "DENY_EXPLICIT", "DENY_DEFAULT", "DENY_MAX_DEPTH", "DENY_EDB_OVERFLOW", "DENY_IDB_OVERFLOW", "DENY_CONFLICT", "DENY_POLICY_LOAD_ERROR")


def deny_reason_name(reason: str) -> str:
    return reason if reason in DENY_REASONS else "DENY_NONE"
