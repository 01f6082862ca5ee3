"""Typed comparisons that fail closed, as plain columns that never raise.

A filter that raises may be pushed below a join and raise for a row that no join would have kept. So a comparison becomes a
status column: 0 false, 1 true, 2 kinds differ or can't be ordered, 3 arithmetic on a non-integer, 4 overflow. Rows with 2
or more are looked for by a separate probe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylog.functions.terms import FIELDS, TYPES, Kinds
from policylog.plans.ir import BOOL, INT, SYMBOL, Arith, Comparison, Const, Expr, Var

FALSE, TRUE, KIND_ERROR, OPERAND_ERROR, OVERFLOW = range(5)
_TESTS = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
_CHECKED = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
Bindings = dict[str, tuple[Column, Kinds]]


def _leaf(e: Const | Var, bound: Bindings) -> tuple[Column, Kinds]:
    return (F.lit(e.value).cast(TYPES[e.kind]), Kinds({e.kind})) if isinstance(e, Const) else bound[e.key]


def _as(column: Column, kinds: Kinds, kind: int) -> Column:
    return column[FIELDS[kind]] if len(kinds) > 1 else column


def _leaves(e: Expr) -> list[Const | Var]:
    return _leaves(e.left) + _leaves(e.right) if isinstance(e, Arith) else [e]


def _value(e: Expr, bound: Bindings) -> Column:
    if isinstance(e, Arith):
        return _CHECKED[e.op](_value(e.left, bound), _value(e.right, bound))
    column, kinds = _leaf(e, bound)
    return _as(column, kinds, INT)


def can_fail(c: Comparison, bound: Bindings) -> bool:
    kinds = [_leaf(x, bound)[1] for e in (c.left, c.right) for x in _leaves(e)]
    if c.arithmetic:
        return True
    one = kinds[0] | kinds[1]
    return len(one) > 1 or c.op not in ("=", "!=") and one != {INT}


def status(c: Comparison, bound: Bindings) -> Column:
    if c.arithmetic:
        out = None
        parts = [_leaf(x, bound) for e in (c.left, c.right) for x in _leaves(e)]
        if any(INT not in kinds for _, kinds in parts):
            return F.lit(OPERAND_ERROR)
        for column, kinds in parts:
            if len(kinds) > 1:
                test = column["kind"] != INT
                out = test if out is None else out | test
        left, right = _value(c.left, bound), _value(c.right, bound)
        made = F.when(left.isNull() | right.isNull(), OVERFLOW).otherwise(_TESTS[c.op](left, right).cast("int"))
        return made if out is None else F.when(out, OPERAND_ERROR).otherwise(made)
    (left, lk), (right, rk) = _leaf(c.left, bound), _leaf(c.right, bound)
    usable = lk & rk if c.op in ("=", "!=") else lk & rk & {INT}
    if not usable:
        return F.lit(KIND_ERROR)

    def is_kind(column: Column, kinds: Kinds, kind: int) -> Column:
        return column["kind"] == kind if len(kinds) > 1 else F.lit(True)

    out = F.lit(KIND_ERROR)
    for kind in (SYMBOL, INT, BOOL):
        if kind in usable:
            test = _TESTS[c.op](_as(left, lk, kind), _as(right, rk, kind)).cast("int")
            if len(lk) == len(rk) == 1:
                return test
            out = F.when(is_kind(left, lk, kind) & is_kind(right, rk, kind), test).otherwise(out)
    return out
