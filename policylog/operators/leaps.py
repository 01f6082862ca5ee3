"""Steps of a recursion that are joined with themselves, so that a long recursion takes few rounds.

Where p(...) :- p(...), rest is the only recursive rule of p, the rest moves some terms of p along pairs that don't depend
on p, and keeps the others. The pairs of 2^n steps are those of 2^(n-1) steps joined with themselves. If every pair's start
has one end, or every end one start, then so have they: there are never more pairs than in the beginning.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylog.operators.rules import KindTable, columns, variable_kinds
from policylog.plans.ir import Atom, Comparison, Rule, Var
from policylog.registry import Kind, Predicate

#: Name of the predicate of the pairs; no rule text can hold it.
PAIRS = "step of "


@dataclass(frozen=True)
class Step:
    """rule derives the pairs: columns for the positions of p that are kept and read (kept), the moved ones that are read
    (read), and where these and all other moved ones go (moved). atoms are the bodies' positive atoms."""

    rule: Rule
    kept: tuple[int, ...]
    read: tuple[int, ...]
    moved: tuple[int, ...]
    kinds: KindTable

    def starts(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(*[f"a{i}" for i in range(len(self.kept) + len(self.read))])

    def ends(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(*[f"a{i}" for i in range(len(self.kept))], *[self._end(i) for i in self.read])

    def _end(self, position: int) -> str:
        return f"a{len(self.kept) + len(self.read) + self.moved.index(position)}"

    def one_to_many(self, pairs: DataFrame, number: int) -> bool:
        """Whether every start has one end or every end one start, so that joining pairs never makes more of them."""
        return any(side.distinct().count() == number for side in (self.starts(pairs), self.ends(pairs)))

    def _join(self, left: DataFrame, at: list[str], pairs: DataFrame) -> DataFrame:
        """left, whose columns at stand where the pairs start, with the pairs' columns as p0, p1, ..."""
        pairs = pairs.toDF(*[f"p{i}" for i in range(len(pairs.columns))])
        return left.join(pairs, functools.reduce(operator.and_, [left[c] == pairs[f"p{i}"] for i, c in enumerate(at)]))

    def ahead(self, facts: DataFrame, pairs: DataFrame) -> DataFrame:
        """Facts of p that the pairs give from facts of p; not distinct."""
        ends = {m: self._end(m).replace("a", "p") for m in self.moved}
        both = self._join(facts, [f"a{i}" for i in (*self.kept, *self.read)], pairs)
        return both.select(*[F.col(ends.get(i, c)).alias(c) for i, c in enumerate(columns(len(facts.columns)))])

    def twice(self, pairs: DataFrame) -> DataFrame:
        """Distinct as the pairs are, since one_to_many holds."""
        begin = len(self.kept) + len(self.read)
        both = self._join(pairs, [*[f"a{i}" for i in range(len(self.kept))], *[self._end(i) for i in self.read]], pairs)
        return both.select(*[F.col(f"a{i}" if i < begin else f"p{i}").alias(f"a{i}") for i in range(len(pairs.columns))])


def step_of(rules: list[Rule], name: str, table: KindTable) -> Step | None:
    """The step of p's recursion; None unless one rule is recursive, reads p once, compares nothing (a comparison may fail
    only for facts that are there), and its rest is one atom, or two that share a variable, besides negated atoms."""
    recursive = [r for r in rules if any(a.predicate.name == name for _, a in r.positives())]
    if len(recursive) != 1 or any(isinstance(x, Comparison) for x in recursive[0].body):
        return None
    rule = recursive[0]
    own = [i for i, a in rule.positives() if a.predicate.name == name]
    rest = [a for i, a in rule.positives() if i != own[0]]
    body, head = rule.body[own[0]].atom.terms, rule.head.terms
    if len(own) != 1 or any(not isinstance(t, Var) for t in (*body, *head)) or any(len({t.key for t in ts}) != len(ts) for ts in (body, head)):
        return None
    named = [{t.key for t in a.terms if isinstance(t, Var) and not t.anonymous} for a in rest]
    known = set().union(*named)
    if len(rest) not in (1, 2) or len(rest) == 2 and not named[0] & named[1] or any(a.variables() - known for _, a in rule.negatives()):
        return None
    kept = tuple(i for i, (b, h) in enumerate(zip(body, head, strict=True)) if b.key == h.key and b.key in known)
    moved = tuple(i for i, (b, h) in enumerate(zip(body, head, strict=True)) if b.key != h.key)
    read = tuple(i for i in moved if body[i].key in known)
    if not read or any(head[i].key not in known for i in moved):
        return None
    terms = (*[body[i] for i in (*kept, *read)], *[head[i] for i in moved])
    at = (*kept, *read, *moved)
    pairs = Rule(rule.rule_id, Atom(Predicate(f"{PAIRS}{name}", len(terms), Kind.IDB), terms), tuple(x for i, x in enumerate(rule.body) if i != own[0]))
    want = variable_kinds(pairs, table)
    kinds = tuple(want[t.key] for t in terms)
    if any(not k for k in want.values()) or any(k != table[name][i] for k, i in zip(kinds, at, strict=True)):
        return None  # columns of different types
    return Step(pairs, kept, read, moved, table | {pairs.head.predicate.name: kinds})
