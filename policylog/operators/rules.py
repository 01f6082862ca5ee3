"""One rule as a DataFrame.

Each atom is a scan whose columns are renamed to the rule's variables after constants, repeated variables and kinds have
been filtered; atoms are joined on the variables they share, negated atoms become anti joins, comparisons filters, and the
head a projection. Everything is declarative, so filters and pruned columns reach the scans and the optimiser picks joins.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog.functions.comparisons import KIND_ERROR, TRUE, can_fail, status
from policylog.functions.terms import Kinds, encode, equals, kinds_of_type, literal, of_kinds, type_of
from policylog.plans.ir import Atom, Comparison, Const, Negative, Positive, Rule, Var

#: Column of a relation without terms.
UNIT = "a"


@dataclass
class Relation:
    """A set of facts: columns a0, a1, ... of the given kinds, or the one column ``a`` if there are no terms."""

    df: DataFrame
    kinds: tuple[Kinds, ...]


@dataclass
class Derivation:
    facts: DataFrame | None
    #: Rows on which a comparison fails (column status); None if it can't.
    failures: list[DataFrame]


KindTable = dict[str, tuple[Kinds, ...]]


def columns(arity: int) -> list[str]:
    return [f"a{i}" for i in range(arity)] or [UNIT]


def variable_kinds(rule: Rule, table: KindTable) -> dict[str, Kinds]:
    """A variable's kinds: those that all its positive positions can hold. Joins across kinds don't match, so other kinds
    never survive."""
    out: dict[str, Kinds] = {}
    for _, atom in rule.positives():
        for term, kinds in zip(atom.terms, table[atom.predicate.name], strict=True):
            if isinstance(term, Var):
                out[term.key] = out.get(term.key, kinds) & kinds
    return out


def infer_kinds(rules: tuple[Rule, ...], base: KindTable) -> KindTable:
    """Kinds of derived positions: what the rules can put there, to a fixpoint."""
    table = dict(base)
    for r in rules:
        table.setdefault(r.head.predicate.name, (Kinds(),) * r.head.predicate.arity)
    grown = True
    while grown:
        grown = False
        for r in rules:
            known = variable_kinds(r, table)
            if any(not k for k in known.values()):
                continue
            name = r.head.predicate.name
            new = tuple(old | (Kinds({t.kind}) if isinstance(t, Const) else known[t.key]) for t, old in zip(r.head.terms, table[name], strict=True))
            if new != table[name]:
                table[name], grown = new, True
    return table


def _scan(atom: Atom, relation: Relation, want: dict[str, Kinds], prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """The atom's rows with one column per distinct named variable; gives the column of each variable."""
    df, first, tests = relation.df, {}, []
    for i, (term, kinds) in enumerate(zip(atom.terms, relation.kinds, strict=True)):
        column = F.col(f"a{i}")
        if isinstance(term, Const):
            tests.append(equals(column, kinds, term))
        elif not term.anonymous:
            if (test := of_kinds(column, kinds, want[term.key])) is not None:
                tests.append(test)
            own = encode(column, kinds, want[term.key])
            if term.key in first:
                tests.append(own == first[term.key])
            else:
                first[term.key] = own
    for test in tests:
        df = df.where(test)
    names = {v: f"{prefix}{v}" for v in first}
    return df.select(*[c.alias(names[v]) for v, c in first.items()] or [F.lit(True).alias(f"{prefix}{UNIT}")]), names


def derive(spark: SparkSession, rule: Rule, scan: Callable[[int, Atom], Relation], table: KindTable, delta: int | None = None) -> Derivation:
    """scan gives the relation to read for the atom at a body position; delta is the position that is read first."""
    want = variable_kinds(rule, table)
    atoms = dict(rule.positives())
    if any(not k for k in want.values()) or any(isinstance(t, Const) and t.kind not in k for a in atoms.values() for t, k in zip(a.terms, table[a.predicate.name])):
        return Derivation(None, [])
    finally_used = rule.head.variables().union(*(x.variables() if isinstance(x, Comparison) else x.atom.variables() for x in rule.body if not isinstance(x, Positive)))
    rows, bound = spark.range(1).select(F.lit(True).alias(UNIT)), {}
    pending = sorted(atoms, key=lambda i: i != delta)  # the delta first, else as written: Catalyst has the statistics
    started = False
    while pending:
        # Whatever shares a variable goes first, so that a cross product is made only where the rule itself is one.
        i = next((i for i in pending if atoms[i].variables() & bound.keys()), pending[0])
        pending.remove(i)
        part, names = _scan(atoms[i], scan(i, atoms[i]), want, f"l{i}_")
        part = part if names else part.limit(1)  # only whether there is such a fact matters
        shared = [v for v in names if v in bound]
        if not started:
            rows, started = part, True
        elif not shared:
            rows = rows.crossJoin(part)
        else:
            on = _all(rows[bound[v]] == part[names[v]] for v in shared)
            rows = rows.join(part, on, "left_semi" if len(shared) == len(names) else "inner")
        bound = names | bound
        live = sorted(bound.keys() & finally_used.union(*(atoms[j].variables() for j in pending)))
        rows = rows.select(*[bound[v] for v in live] or [F.lit(True).alias(UNIT)])
        bound = {v: bound[v] for v in live}
    failures = []
    for i, x in enumerate(rule.body):
        if isinstance(x, Comparison):
            values = {v: (F.col(c), want[v]) for v, c in bound.items()}
            verdict = status(x, values)
            if can_fail(x, values):
                failures.append(rows.select(verdict.alias("status")).where(F.col("status") >= KIND_ERROR))
            rows = rows.where(verdict == TRUE)
        elif isinstance(x, Negative):
            rows = _without(rows, x.atom, scan(i, x.atom), want, bound, f"n{i}_")
    made = []
    for i, (t, k) in enumerate(zip(rule.head.terms, table[rule.head.predicate.name], strict=True)):
        made.append((literal(t, k) if isinstance(t, Const) else encode(F.col(bound[t.key]), want[t.key], k)).alias(f"a{i}"))
    return Derivation(rows.select(*made or [F.lit(True).alias(UNIT)]), failures)


def join_size(rule: Rule, scan: Callable[[int, Atom], Relation], table: KindTable) -> float:
    """How many rows the join of the rule's two atoms has, without making them."""
    want, sides = variable_kinds(rule, table), []
    shared = sorted(set.intersection(*(a.variables() for _, a in rule.positives())))
    for i, atom in rule.positives():
        part, names = _scan(atom, scan(i, atom), want, f"l{i}_")
        sides.append(part.groupBy(*[F.col(names[v]).alias(f"{i}_{v}") for v in shared]).agg(F.count(F.lit(1)).cast("double").alias(f"n{i}")))
    (i, _), (j, _) = rule.positives()
    both = sides[0].join(sides[1], _all(sides[0][f"{i}_{v}"] == sides[1][f"{j}_{v}"] for v in shared))
    return both.agg(F.sum(F.col(f"n{i}") * F.col(f"n{j}"))).first()[0] or 0.0


def _all(tests):
    return functools.reduce(operator.and_, tests)


def _without(rows: DataFrame, atom: Atom, relation: Relation, want: dict[str, Kinds], bound: dict[str, str], prefix: str) -> DataFrame:
    """Anti join; every variable of a negated atom is bound, and there are no nulls. Where a side is mixed both are compared
    as structs."""
    df, sides = relation.df, []
    for i, (term, kinds) in enumerate(zip(atom.terms, relation.kinds, strict=True)):
        column = F.col(f"a{i}")
        own = Kinds({term.kind}) if isinstance(term, Const) else want[term.key]
        if not kinds & own:
            return rows
        if isinstance(term, Const):
            df = df.where(equals(column, kinds, term))
        else:
            both = kinds | own
            sides.append((encode(column, kinds, both), encode(F.col(bound[term.key]), own, both)))
    names = [f"{prefix}{i}" for i in range(len(sides))]
    right = df.select(*[c.alias(n) for n, (c, _) in zip(names, sides)] or [F.lit(True).alias(f"{prefix}{UNIT}")])
    if not sides:
        return rows.join(right.limit(1), F.lit(True), "left_anti")
    return rows.join(right, _all(own == F.col(n) for n, (_, own) in zip(names, sides)), "left_anti")


def empty(spark, kinds: tuple[Kinds, ...]) -> Relation:
    ddl = ", ".join(f"a{i} {type_of(k)}" for i, k in enumerate(kinds)) or f"{UNIT} boolean"
    return Relation(spark.createDataFrame([], ddl), kinds)


def relation_of(df: DataFrame) -> Relation:
    """Any DataFrame as a relation: integral columns become bigint; types other than string and boolean are refused."""
    found = [kinds_of_type(f.dataType) for f in df.schema.fields]
    named = df.toDF(*[f"c{i}" for i in range(len(found))])
    made = [(F.col(f"c{i}").cast(to) if to else F.col(f"c{i}")).alias(f"a{i}") for i, (_, to) in enumerate(found)]
    return Relation(named.select(*made or [F.lit(True).alias(UNIT)]), tuple(k for k, _ in found))
