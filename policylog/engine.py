"""The public interface: engines hold domains, rulesets hold programs, solving gives relations."""

from __future__ import annotations

import functools
import hashlib
import operator
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog.errors import Code, DatalogError
from policylog.explain import Explanation, Fact, ProofNode, Trace, document, to_fact, trace_limit
from policylog.functions.decision import Decision, decide
from policylog.functions.terms import Kinds, const, encode, equals, kind_of
from policylog.limits import SMALL, UNBOUNDED, Limits
from policylog.operators.fixpoint import Model, solve
from policylog.operators.rules import Relation, columns, empty, relation_of
from policylog.plans.canonical import canonical_sha256
from policylog.plans.ir import SYMBOL, Program
from policylog.plans.parser import parse
from policylog.registry import Domains, Kind, Predicate, Registry
from policylog.sources.edb import Edb, Value, rows_relation

DEFAULT_PROFILE = "POLICYLOG-v2"


class Engine:
    """limits hold for solving (UNBOUNDED for DataFrames of any size; SMALL and LARGE fail closed). profile names the rule
    language in manifests, canonical forms and explanations."""

    def __init__(self, spark: SparkSession, limits: Limits = UNBOUNDED, profile: str = DEFAULT_PROFILE, variables: str = "letter"):
        self.spark, self.limits, self.profile, self.variables = spark, limits, profile, variables
        self.domains = Domains(limits)
        self.closed = False

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.closed = True

    def register_domain(self, name: str, predicates: Iterable[Predicate] | Callable[[Registry], None]) -> None:
        self._open()
        self.domains.register(name, predicates)

    def load_inline_ruleset(self, domain: str, policy_id: str, source: str | bytes, mode: str = "enforce", file: str | None = None) -> Ruleset:
        self._open()
        if not re.fullmatch(r"\S{1,127}", policy_id):
            raise DatalogError(Code.INVALID_ARGUMENT, f"invalid policy id {policy_id!r}")
        registry = self.domains.registry(domain).freeze()
        program = parse(source, registry, self.limits, file, self.variables)
        digest = hashlib.sha256(source.encode() if isinstance(source, str) else source).hexdigest()
        return Ruleset(self, domain, policy_id, registry, program, digest, mode)

    def load_inline_with_domain(self, domain: str, predicates: Iterable[Predicate], policy_id: str, source: str | bytes) -> Ruleset:
        self.register_domain(domain, predicates)
        return self.load_inline_ruleset(domain, policy_id, source)

    def _open(self) -> None:
        if self.closed:
            raise DatalogError(Code.INVALID_STATE, "the engine is closed")


class Ruleset:
    def __init__(self, engine: Engine, domain: str, policy_id: str, registry: Registry, program: Program, sha256: str, mode: str = "enforce"):
        self.engine, self.domain, self.policy_id, self.registry, self.program, self.sha256, self.mode = engine, domain, policy_id, registry, program, sha256, mode
        self.symbols: dict[str, int] = {}
        self.texts: list[str] = []
        self.whitelist: set[tuple[str, int]] | None = None
        for s in program.symbols:
            self.intern_symbol(s)

    def edb(self) -> Edb:
        return Edb(self.engine.spark, self, self.engine.limits)

    def intern_symbol(self, text: str) -> int:
        """A number from 1, by first use."""
        if text not in self.symbols:
            self.texts.append(text)
            self.symbols[text] = len(self.texts)
        return self.symbols[text]

    def symbol_text(self, number: int) -> str | None:
        return self.texts[number - 1] if 0 < number <= len(self.texts) else None

    def canonical_sha256(self, stored: str | None = None) -> str:
        return canonical_sha256(self.policy_id, self.domain, self.engine.profile, self.registry, self.program, stored)

    def solve(self, edb: Edb) -> SolveResult:
        """Closes the EDB and evaluates; any failure leaves no result."""
        if self.engine.closed:
            raise DatalogError(Code.INVALID_STATE, "the engine is closed", category="invalid_state")
        if edb.ruleset is not self:
            raise DatalogError(Code.INVALID_ARGUMENT, "the EDB belongs to another ruleset", "create it with this ruleset's edb()", category="invalid_argument")
        base = edb.finalize()
        for rows in edb.rows.values():
            for fact in rows:
                for term in fact:
                    if term.kind == SYMBOL:
                        self.intern_symbol(term.value)
        spark = self.engine.spark
        for name, predicate in self.registry.predicates.items():
            if predicate.kinds & Kind.POLICY_FACT:
                rows = dict.fromkeys(f.terms for f in self.program.facts if f.predicate.name == name)
                base[name] = rows_relation(spark, [tuple(t.value for t in f) for f in rows], predicate.arity)
        return SolveResult(self, base, solve(spark, self.program, base, self.engine.limits))


class SolveResult:
    def __init__(self, ruleset: Ruleset, base: dict[str, Relation], model: Model):
        self.ruleset, self.base, self.model = ruleset, base, model

    # -- checks ----------------------------------------------------------------------------------------------------

    def _queryable(self, name: str, arity: int | None = None) -> Predicate:
        """First the whitelist, then the registry, then the QUERY flag."""
        listed = self.ruleset.whitelist
        if listed is not None and not any(n == name and arity in (None, a) for n, a in listed):
            raise DatalogError(Code.FORBIDDEN, f"{name!r} is not in the query whitelist")
        predicate = self.ruleset.registry.find(name)
        if arity is not None and predicate.arity != arity or not predicate.kinds & Kind.QUERY:
            raise DatalogError(Code.INVALID_FIELD, f"{name!r} can't be queried like this")
        return predicate

    def validate_query(self, name: str, *terms: Value) -> Predicate:
        if len(terms) > self.ruleset.engine.limits.arity:
            raise DatalogError(Code.INVALID_ARGUMENT, "too many terms")
        for t in terms:
            kind_of(t)
        return self._queryable(name, len(terms))

    # -- relations -------------------------------------------------------------------------------------------------

    def _derived(self, predicate: Predicate) -> Relation:
        return self.model.derived.get(predicate.name) or empty(self.ruleset.engine.spark, (Kinds(),) * predicate.arity)

    def relation(self, name: str, limit: int | None = None) -> DataFrame:
        """The derived facts of a queryable predicate; base predicates have none. limit is a capacity: which facts make it is
        not defined, and relation(name).count() tells how many there are."""
        df = self._derived(self._queryable(name)).df
        return df if limit is None else df.limit(limit)

    enumerate_predicate_facts = relation

    def facts(self, name: str) -> DataFrame:
        """All facts of a predicate wherever they come from; no query rights are needed."""
        predicate = self.ruleset.registry.find(name)
        return (self.base[name] if name in self.base else self._derived(predicate)).df.distinct()

    def canonical(self, name: str) -> DataFrame:
        """relation(name) in canonical order: term by term by kind, then by value; symbols by their text, as DataFrames of any
        size have no order of interning."""
        df = self.relation(name)
        return df.orderBy(*df.columns)

    def count(self, name: str) -> int:
        return self.relation(name).count()

    def enumerate_capacity(self, name: str, capacity: int) -> tuple[list[tuple], int]:
        """At most capacity facts and how many there are in all; capacity 0 only counts."""
        df = self.relation(name)
        predicate = self.ruleset.registry.find(name)
        rows = [tuple(r)[: predicate.arity] for r in df.limit(capacity).collect()] if capacity else []
        return rows, df.count()

    @property
    def derived_fact_count(self) -> int:
        return sum(r.df.count() for r in self.model.derived.values())

    def contains_fact(self, name: str, *terms: Value) -> bool:
        """Ground membership among rule text facts, base facts and derived facts."""
        predicate = self.validate_query(name, *terms)
        relation = self.base[name] if name in self.base else self._derived(predicate)
        df = relation.df
        for i, (t, k) in enumerate(zip(terms, relation.kinds)):
            df = df.where(equals(F.col(f"a{i}"), k, const(t)))
        return not df.isEmpty()

    def contains_batch(self, name: str, queries: DataFrame) -> DataFrame:
        """queries (columns by position) with a boolean column contained: one join instead of a job per fact. Rows with a
        null are not contained."""
        predicate = self._queryable(name, len(queries.columns))
        relation = self.base[name] if name in self.base else self._derived(predicate)
        asked = relation_of(queries)
        names = columns(predicate.arity)
        both = [a | b for a, b in zip(asked.kinds, relation.kinds)]
        keys = [encode(F.col(c), k, w).alias(f"k_{c}") for c, k, w in zip(names, relation.kinds, both)]
        known = relation.df.select(*keys).distinct().withColumn("_found", F.lit(True))
        left = asked.df.select(*names, *[encode(F.col(c), k, w).alias(f"q_{c}") for c, k, w in zip(names, asked.kinds, both)])
        on = functools.reduce(operator.and_, [left[f"q_{c}"] == known[f"k_{c}"] for c in names])
        return left.join(known, on, "left").select(*names, F.coalesce("_found", F.lit(False)).alias("contained")).toDF(*queries.columns, "contained")

    def decision(self, subject: tuple[Value, ...] = (), allow: str = "allow", deny: str = "deny", reduce: str = "reduce") -> Decision:
        return decide(*(self.contains_fact(n, *subject) for n in (deny, reduce, allow)))

    # -- explanations ----------------------------------------------------------------------------------------------

    @functools.cached_property
    def trace(self) -> Trace:
        limits = self.ruleset.engine.limits
        most = trace_limit(limits)
        edb: list[Fact] = []
        policy = [to_fact(f.predicate.name, tuple(t.value for t in f.terms)) for f in self.ruleset.program.facts]
        for name, relation in self.base.items():
            if self.ruleset.registry.find(name).kinds & Kind.EDB:
                rows = relation.df.distinct().limit(most + 1).collect()
                edb += [to_fact(name, tuple(self._plain(v) for v in r)[: len(relation.kinds)]) for r in rows]
                if len(edb) > most:
                    raise DatalogError(Code.PAYLOAD_TOO_LARGE, f"explanations are made for at most {most} base facts")
        for s in sorted({c.value for f in edb for c in f[1] if c.kind == SYMBOL} - self.ruleset.symbols.keys()):
            self.ruleset.intern_symbol(s)
        return Trace(self.ruleset.program, list(dict.fromkeys(policy)), edb, self.ruleset.symbols, limits)

    @staticmethod
    def _plain(value) -> Value:
        return next(v for v in (value.s, value.i, value.b) if v is not None) if hasattr(value, "kind") else value

    def proof(self) -> list[ProofNode]:
        return list(self.trace.nodes)

    def proof_of(self, name: str, *terms: Value) -> list[ProofNode]:
        self.validate_query(name, *terms)
        return self.trace.proof_of(to_fact(name, terms))

    def explain(self, name: str, *terms: Value) -> Explanation:
        self.validate_query(name, *terms)
        return self.trace.explain(to_fact(name, terms))

    def explain_document(self, name: str, *terms: Value) -> str:
        return document(self.explain(name, *terms), self.ruleset.engine.profile)

    def explain_fact_text(self, name: str, *terms: Value) -> str | None:
        found = self.explain(name, *terms)
        return None if found.status == "not-derived" else document(found, self.ruleset.engine.profile)


def build_limits(limits: Limits = SMALL) -> dict[str, int | None]:
    return limits.as_dict()
