"""Columns that hold terms. A position that only ever holds one kind is a plain STRING, BIGINT or BOOLEAN column; a mixed
one is a struct (kind, s, i, b) in which only the kind's own field is set, so that equal structs are equal terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylog.errors import Code, DatalogError
from policylog.plans.ir import BOOL, INT, SYMBOL, Const

FIELDS = {SYMBOL: "s", INT: "i", BOOL: "b"}
TYPES = {SYMBOL: "string", INT: "bigint", BOOL: "boolean"}
MIXED = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("s", T.StringType()), T.StructField("i", T.LongType()), T.StructField("b", T.BooleanType())])
MIXED_DDL = "struct<kind:tinyint,s:string,i:bigint,b:boolean>"

Kinds = frozenset


def type_of(kinds: Kinds) -> str:
    """The column type of a position with these kinds; a position without facts counts as a symbol's."""
    return MIXED_DDL if len(kinds) > 1 else TYPES[next(iter(kinds), SYMBOL)]


def kind_of(value: object) -> int:
    """bool before int, as True is also an int."""
    for kind, of in ((BOOL, bool), (INT, int), (SYMBOL, str)):
        if isinstance(value, of):
            return kind
    raise DatalogError(Code.INVALID_FIELD, f"a term must be a string, integer or boolean, not {type(value).__name__}")


def const(value: object) -> Const:
    return Const(kind_of(value), value)


def kinds_of_type(t: T.DataType) -> tuple[Kinds, str | None]:
    """Kinds that a DataFrame column of this type may hold, and the type to cast it to."""
    if isinstance(t, T.StringType):
        return Kinds({SYMBOL}), None
    if isinstance(t, T.BooleanType):
        return Kinds({BOOL}), None
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kinds({INT}), "bigint"
    if t == MIXED or isinstance(t, T.StructType) and t.simpleString() == MIXED_DDL:
        return Kinds({SYMBOL, INT, BOOL}), None
    raise DatalogError(Code.INVALID_FIELD, f"terms can't be {t.simpleString()}", "cast to string, bigint or boolean first")


def encode(column: Column, have: Kinds, want: Kinds) -> Column:
    """A column of kinds have as one of kinds want; callers have filtered out kinds that are not wanted."""
    if len(have) > 1 and len(want) > 1 or len(have) <= 1 and len(want) <= 1:
        return column
    if len(have) > 1:
        return column[FIELDS[next(iter(want))]]
    kind = next(iter(have))
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), *[(column if k == kind else F.lit(None).cast(TYPES[k])).alias(FIELDS[k]) for k in (SYMBOL, INT, BOOL)])


def of_kinds(column: Column, have: Kinds, want: Kinds) -> Column | None:
    """The filter that keeps only wanted kinds, if one is needed."""
    return column["kind"].isin(*(sorted(want))) if len(have) > 1 and not have <= want else None


def literal(c: Const, kinds: Kinds) -> Column:
    return encode(F.lit(c.value).cast(TYPES[c.kind]), Kinds({c.kind}), kinds)


def equals(column: Column, have: Kinds, c: Const) -> Column:
    if c.kind not in have:
        return F.lit(False)
    own = column[FIELDS[c.kind]] if len(have) > 1 else column
    test = own == F.lit(c.value).cast(TYPES[c.kind])
    return (column["kind"] == c.kind) & test if len(have) > 1 else test
