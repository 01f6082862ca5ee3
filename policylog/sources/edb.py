"""The base facts of one solve: rows that are added one by one or in batches, and DataFrames of any size."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog.errors import Code, DatalogError
from policylog.functions.terms import FIELDS, Kinds, const, encode, kind_of, type_of
from policylog.limits import Limits
from policylog.operators.rules import UNIT, Relation, columns, empty, relation_of
from policylog.plans.ir import Const
from policylog.registry import Kind, Predicate

if TYPE_CHECKING:
    from policylog.engine import Ruleset

Value = str | int | bool


def rows_relation(spark: SparkSession, rows: list[tuple[Value, ...]], arity: int) -> Relation:
    """Local rows as a relation; positions that hold several kinds become structs."""
    kinds = tuple(Kinds(kind_of(r[i]) for r in rows) for i in range(arity))
    if not rows:
        return empty(spark, kinds)

    def cell(v: Value, k: Kinds):
        own = kind_of(v)
        return (own, *(v if own == x else None for x in FIELDS)) if len(k) > 1 else v

    ddl = ", ".join(f"a{i} {type_of(k)}" for i, k in enumerate(kinds)) or f"{UNIT} boolean"
    data = [tuple(cell(v, k) for v, k in zip(r, kinds)) if arity else (True,) for r in rows]
    return Relation(spark.createDataFrame(data, ddl), kinds)


class Edb:
    """Open until it is finalized (solving does that); then sorted out to sets and immutable."""

    def __init__(self, spark: SparkSession, ruleset: Ruleset, limits: Limits):
        self.spark, self.ruleset, self.limits = spark, ruleset, limits
        self.rows: dict[str, dict[tuple[Const, ...], None]] = {}  # as terms: 1 and True are different facts
        self.frames: dict[str, list[DataFrame]] = {}
        self.final = False

    def _predicate(self, name: str, arity: int) -> Predicate:
        if self.final:
            raise DatalogError(Code.INVALID_STATE, "the EDB is closed", "create another one with ruleset.edb()")
        predicate = self.ruleset.registry.find(name)
        if predicate.kinds & Kind.POLICY_FACT:
            raise DatalogError(Code.FORBIDDEN, f"{name!r} takes its facts from the rule text only")
        if not predicate.kinds & Kind.EDB:
            raise DatalogError(Code.INVALID_FIELD, f"{name!r} is derived and takes no facts")
        if predicate.arity != arity:
            raise DatalogError(Code.INVALID_FIELD, f"{name!r} takes {predicate.arity} terms, not {arity}")
        return predicate

    def _check(self, value: Value) -> Const:
        if kind_of(value) == 1 and len(value.encode()) > self.limits.string_bytes:
            raise DatalogError(Code.PAYLOAD_TOO_LARGE, "symbol too long")
        if kind_of(value) == 2 and not -(1 << 63) <= value < 1 << 63:
            raise DatalogError(Code.INVALID_FIELD, "integer out of the 64-bit range")
        return const(value)

    def _room(self, name: str, more: int) -> None:
        cap, total = self.limits.facts_per_predicate, self.limits.edb_facts
        if cap is not None and len(self.rows.get(name, ())) + more > cap or total is not None and sum(map(len, self.rows.values())) + more > total:
            raise DatalogError(Code.PAYLOAD_TOO_LARGE, "too many base facts", deny_reason="DENY_EDB_OVERFLOW")

    def add_fact(self, name: str, *terms: Value) -> None:
        """A fact that is already there is accepted and changes nothing."""
        self._predicate(name, len(terms))
        fact = tuple(map(self._check, terms))
        if fact not in self.rows.get(name, ()):
            self._room(name, 1)
            self.rows.setdefault(name, {})[fact] = None

    def add_atom(self, name: str, atom: str) -> None:
        """A unary fact whose symbol must be in the domain's closed vocabulary."""
        self._predicate(name, 1)
        if atom not in self.ruleset.registry.atoms:
            raise DatalogError(Code.FORBIDDEN, f"{atom!r} is not in the domain's vocabulary")
        self.add_fact(name, atom)

    def add_facts(self, name: str, facts: Iterable[tuple[Value, ...]]) -> None:
        """All or none. Repeated facts in the batch count for the capacity check; an empty batch is fine."""
        batch = [tuple(map(self._check, f)) for f in facts]
        for f in batch:
            self._predicate(name, len(f))
        self._room(name, len(batch))
        if batch:
            self.rows.setdefault(name, {}).update(dict.fromkeys(batch))

    def intern_symbol(self, text: str) -> int:
        """The ruleset's number of a symbol, for add_symbol_ids."""
        if self.final:
            raise DatalogError(Code.INVALID_STATE, "the EDB is closed", "create another one with ruleset.edb()")
        return self.ruleset.intern_symbol(self._check(text).value)

    def _texts(self, name: str, ids: tuple[int, ...]) -> tuple[str, ...]:
        self._predicate(name, len(ids))
        texts = tuple(self.ruleset.symbol_text(i) for i in ids)
        if None in texts:
            raise DatalogError(Code.INVALID_ARGUMENT, "a number without a symbol", "intern symbols first")
        return texts

    def add_symbol_ids(self, name: str, *ids: int) -> None:
        """A fact of symbols by the numbers that intern_symbol gave."""
        self.add_fact(name, *self._texts(name, ids))

    def add_symbol_id_facts(self, name: str, facts: Iterable[tuple[int, ...]]) -> None:
        """add_facts by numbers: all or none."""
        self.add_facts(name, [self._texts(name, f) for f in facts])

    def clear(self) -> None:
        """Empty and open again, also after solving; results that were made of it stay as they are."""
        self.rows, self.frames, self.final = {}, {}, False

    def add_dataframe(self, name: str, df: DataFrame) -> None:
        """The rows of a DataFrame as facts, by position; repeats are fine. Columns must be integral, string, boolean or the
        mixed struct. A null or a string over the limit fails the solve: a policy must not lose facts in silence."""
        self._predicate(name, len(df.columns) if df.columns != [UNIT] else 0)
        relation_of(df)
        self.frames.setdefault(name, []).append(df)

    def finalize(self) -> dict[str, Relation]:
        self.final = True
        out = {}
        for name, predicate in self.ruleset.registry.predicates.items():
            if predicate.kinds & Kind.EDB:
                out[name] = self._relation(name, predicate.arity)
        if (faults := self.faults(out)) is not None:
            worst = faults.agg(F.max("nulls").alias("nulls"), F.max("long").alias("long")).first()
            if worst.nulls:
                raise DatalogError(Code.INVALID_FIELD, "a base fact holds a null", "filter or fill nulls before add_dataframe", category="malformed_edb", deny_reason="DENY_EDB_MALFORMED")
            if worst.long:
                raise DatalogError(Code.PAYLOAD_TOO_LARGE, "a base fact holds a string over the limit", category="malformed_edb", deny_reason="DENY_EDB_MALFORMED")
        if self.limits.edb_facts is not None and self.frames:
            self._count(out)
        return out

    def _relation(self, name: str, arity: int) -> Relation:
        parts = [relation_of(df) for df in self.frames.get(name, [])]
        if self.rows.get(name) or not parts:
            parts.append(rows_relation(self.spark, [tuple(c.value for c in f) for f in self.rows.get(name, ())], arity))
        if len(parts) == 1 and not self.frames.get(name):
            return parts[0]
        kinds = tuple(Kinds().union(*(p.kinds[i] for p in parts)) for i in range(arity))
        frames = [p.df.select(*[encode(F.col(f"a{i}"), k, w).alias(f"a{i}") for i, (k, w) in enumerate(zip(p.kinds, kinds))] or [F.lit(True).alias(UNIT)]) for p in parts]
        df = frames[0]
        for more in frames[1:]:
            df = df.unionByName(more)
        return Relation(df, kinds)

    def faults(self, relations: dict[str, Relation]) -> DataFrame | None:
        """How many rows of DataFrames hold a null (column nulls) or a string over the limit (column long); None if there can
        be neither. It is lazy: the solver asks for it once, together for all predicates."""
        found = []
        for name in self.frames:
            df, kinds = relations[name].df, relations[name].kinds
            texts = [F.col(f"a{i}") if len(k) == 1 else F.col(f"a{i}.{FIELDS[1]}") for i, k in enumerate(kinds) if 1 in k]
            null = functools.reduce(operator.or_, [F.col(f"a{i}").isNull() for i in range(len(kinds))], F.lit(False))
            long = functools.reduce(operator.or_, [F.coalesce(F.octet_length(t) > self.limits.string_bytes, F.lit(False)) for t in texts], F.lit(False))
            if kinds:
                found.append(df.agg(F.max(null.cast("int")).alias("nulls"), F.max(long.cast("int")).alias("long")))
        return functools.reduce(DataFrame.unionByName, found) if found else None

    def _count(self, relations: dict[str, Relation]) -> None:
        """Only under limits: distinct facts per predicate, in one action."""
        counts = [r.df.distinct().agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, r in relations.items()]
        df = counts[0]
        for c in counts[1:]:
            df = df.unionByName(c)
        found = {r.name: r.n for r in df.collect()}  # one row per predicate
        if any(n > self.limits.facts_per_predicate for n in found.values()) or sum(found.values()) > self.limits.edb_facts:
            raise DatalogError(Code.PAYLOAD_TOO_LARGE, "too many base facts", category="malformed_edb", deny_reason="DENY_EDB_OVERFLOW")
