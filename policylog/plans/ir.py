"""The logical form of rules: immutable terms, atoms, comparisons and rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from policylog.registry import Predicate

# Kinds of terms and their numbers.
SYMBOL, INT, BOOL, VARIABLE = 1, 2, 3, 4
KIND_NAMES = {SYMBOL: "symbol", INT: "int", BOOL: "bool"}
#: Comparison operators in the order of their numbers, from 1.
OPERATORS = ("=", "!=", "<", "<=", ">", ">=")
ANONYMOUS = 26


@dataclass(frozen=True)
class Const:
    kind: int
    value: str | int | bool


@dataclass(frozen=True)
class Var:
    """index: 0 to 25 for named variables (the first letter), from 26 for anonymous ones, as the canonical form has it; key
    tells variables apart."""

    index: int
    key: str

    @property
    def anonymous(self) -> bool:
        return self.index >= ANONYMOUS


Term = Const | Var


@dataclass(frozen=True)
class Atom:
    predicate: Predicate
    terms: tuple[Term, ...]

    def variables(self) -> set[str]:
        return {t.key for t in self.terms if isinstance(t, Var)}


@dataclass(frozen=True)
class Arith:
    """op is one of + - *."""

    op: str
    left: Expr
    right: Expr


Expr = Const | Var | Arith


def expression_variables(e: Expr) -> set[str]:
    if isinstance(e, Arith):
        return expression_variables(e.left) | expression_variables(e.right)
    return {e.key} if isinstance(e, Var) else set()


@dataclass(frozen=True)
class Positive:
    atom: Atom


@dataclass(frozen=True)
class Negative:
    atom: Atom


@dataclass(frozen=True)
class Comparison:
    op: str
    left: Expr
    right: Expr

    @property
    def arithmetic(self) -> bool:
        return isinstance(self.left, Arith) or isinstance(self.right, Arith)

    def variables(self) -> set[str]:
        return expression_variables(self.left) | expression_variables(self.right)


Literal = Positive | Negative | Comparison


@dataclass(frozen=True)
class Rule:
    rule_id: int
    head: Atom
    body: tuple[Literal, ...]

    def positives(self) -> Iterator[tuple[int, Atom]]:
        return ((i, x.atom) for i, x in enumerate(self.body) if isinstance(x, Positive))

    def negatives(self) -> Iterator[tuple[int, Atom]]:
        return ((i, x.atom) for i, x in enumerate(self.body) if isinstance(x, Negative))

    def bound(self) -> set[str]:
        return set().union(*(a.variables() for _, a in self.positives()))


@dataclass(frozen=True)
class Program:
    facts: tuple[Atom, ...]
    rules: tuple[Rule, ...]
    strata: dict[str, int]
    negation: bool
    warnings: tuple[str, ...] = ()
    #: Strings of the rule text, in the order in which they first occur.
    symbols: tuple[str, ...] = ()

    @property
    def max_stratum(self) -> int:
        return max(self.strata.values(), default=0)
