"""The least model of a program, stratum by stratum.

Unlimited programs are evaluated by strongly connected groups of predicates. Groups without recursion that one atom reads
stay lazy: they are plain unions of joins with one distinct, and the optimiser sees through all of them. Those that several
atoms read are computed once. Recursive groups run a semi-naive loop: each round joins the facts that are new since the last
round, old facts elsewhere, and removes what is known. Every round's new facts are checkpointed reliably, which counts them
and cuts the plan at once; what the rounds read from outside is computed once and as a set, before the first of them. A long
recursion goes on in leaps of 1, 2, 4, ... steps where its rule allows that (leaps.py).

Programs under fact or depth limits are evaluated in rounds over all predicates of a stratum together, because the depth
limit counts those rounds.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog.errors import Code, DatalogError
from policylog.limits import Limits
from policylog.operators.leaps import Step, step_of
from policylog.operators.rules import Derivation, KindTable, Relation, columns, derive, empty, infer_kinds, join_size
from policylog.operators.storage import settle
from policylog.plans.analyze import components
from policylog.plans.ir import Atom, Program, Rule

#: Known facts from which a round first settles its candidates, so that the known ones need only be scanned for them.
SCAN_KNOWN = 1_000_000
#: Rounds after which the pieces of a growing relation are merged into one checkpoint.
MERGE_EVERY = 8
#: Rounds after which a recursion counts as long, and goes on in leaps if it can.
LEAP_AFTER = 4
#: Pairs of one step that are still made, as a multiple of the facts that they are made of and that are known by then.
MOST_PAIRS = 4
#: Of the known facts, the share that new ones have while they are still compared with all in one join.
FEW_NEW = 8


@dataclass
class Model:
    """Derived relations, and how many facts they hold where evaluation had to count them."""

    derived: dict[str, Relation]
    counts: dict[str, int] = field(default_factory=dict)
    rounds: int = 0


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _match(left: DataFrame, right: DataFrame, arity: int, how: str) -> DataFrame:
    names = columns(arity)
    right = right.select(*[F.col(n).alias(f"k_{n}") for n in names])
    return left.join(right, functools.reduce(operator.and_, [left[n] == right[f"k_{n}"] for n in names]), how)


def _minus(new: DataFrame, known: DataFrame, arity: int, known_rows: int = 0) -> DataFrame:
    """new without known. Where much is known, the few candidates are settled and looked up in it first: they are small
    enough to be broadcast in most rounds, so the known facts are scanned but not shuffled."""
    if known_rows < SCAN_KNOWN:
        return _match(new, known, arity, "left_anti")
    new = settle(new)
    return _match(new, _match(known, new, arity, "left_semi"), arity, "left_anti")


class Solver:
    def __init__(self, spark: SparkSession, program: Program, base: dict[str, Relation], limits: Limits):
        self.spark, self.program, self.base, self.limits = spark, program, base, limits
        self.kinds: KindTable = infer_kinds(program.rules, {n: r.kinds for n, r in base.items()})
        self.model = Model({})
        self.failures: list[DataFrame] = []
        self.readers = Counter(a.predicate.name for r in program.rules for _, a in (*r.positives(), *r.negatives()))
        self.settled: dict[str, Relation] = {}

    def run(self) -> Model:
        for stratum in range(self.program.max_stratum + 1):
            rules = tuple(r for r in self.program.rules if self.program.strata[r.head.predicate.name] == stratum)
            if self.limits.fixpoint_depth is None:
                for names, recursive in components(rules):
                    own = [r for r in rules if r.head.predicate.name in names]
                    if recursive:
                        self.recursive(own, names)
                    else:
                        self.plain(own, names[0])
            else:
                self.in_rounds(rules)
        self.probe()
        return self.model

    # -- parts -----------------------------------------------------------------------------------------------------

    def relation(self, atom: Atom) -> Relation:
        name = atom.predicate.name
        if name in self.settled:
            return self.settled[name]
        if name in self.base:
            return self.base[name]
        return self.model.derived.get(name) or empty(self.spark, self.kinds.get(name, (frozenset(),) * atom.predicate.arity))

    def probe(self) -> None:
        """One action over all comparisons that could fail so far."""
        pending, self.failures = self.failures, []
        if pending and (worst := _union(pending).agg(F.max("status")).first()[0]):
            raise DatalogError(Code.INVALID_FIELD, "comparison of terms that can't be compared, or integer overflow", "guard the comparison by the facts' kinds", category="comparison_type_error", deny_reason=f"DENY_COMPARISON_TYPE_ERROR:{worst}")

    def made(self, name: str, derivations: list[Derivation]) -> DataFrame:
        parts = [d.facts for d in derivations if d.facts is not None]
        self.failures += [f for d in derivations for f in d.failures]
        return _union(parts).distinct() if parts else empty(self.spark, self.kinds[name]).df

    def plain(self, rules: list[Rule], name: str) -> None:
        df = self.made(name, [derive(self.spark, r, lambda _, a: self.relation(a), self.kinds) for r in rules])
        self.model.derived[name] = Relation(df, self.kinds[name])
        if self.readers[name] > 1:  # else its joins would be planned and run once for each of them
            self.model.derived[name] = self.settle_once(name, self.model.derived[name])

    def settle_once(self, name: str, relation: Relation) -> Relation:
        if name not in self.settled:
            # a set: repeated base facts would multiply the rows of every join with them
            df = settle(relation.df.distinct() if name in self.base else relation.df)
            self.settled[name] = Relation(df, relation.kinds)
        return self.settled[name]

    def check_caps(self) -> None:
        cap, total = self.limits.facts_per_predicate, self.limits.idb_facts
        if cap is not None and any(n > cap for n in self.model.counts.values()) or total is not None and sum(self.model.counts.values()) > total:
            raise DatalogError(Code.PAYLOAD_TOO_LARGE, "too many derived facts", category="idb_overflow", deny_reason="DENY_IDB_OVERFLOW")

    def recursive(self, rules: list[Rule], names: list[str]) -> None:
        def all_parts(name: str, parts: list[DataFrame]) -> Relation:
            return Relation(_union(parts), self.kinds[name]) if parts else empty(self.spark, self.kinds[name])

        parts: dict[str, list[DataFrame]] = {n: [] for n in names}
        old: dict[str, list[DataFrame]] = {n: [] for n in names}
        delta: dict[str, DataFrame] = {}
        rows = dict.fromkeys(names, 0)
        for r in rules:
            if any(a.predicate.name in names for _, a in r.positives()):
                for _, a in (*r.positives(), *r.negatives()):
                    if a.predicate.name not in names:
                        self.settle_once(a.predicate.name, self.relation(a))
        number = 0
        while True:
            if number > self.limits.safety_rounds:
                raise DatalogError(Code.PAYLOAD_TOO_LARGE, "too many rounds", category="max_depth", deny_reason="DENY_MAX_DEPTH")
            found: dict[str, list[Derivation]] = {n: [] for n in names}
            for r in rules:
                inside = [i for i, a in r.positives() if a.predicate.name in names]
                if number == 0 and not inside:
                    found[r.head.predicate.name].append(derive(self.spark, r, lambda _, a: self.relation(a), self.kinds))
                for at in inside if number else []:
                    if r.body[at].atom.predicate.name not in delta:
                        continue

                    def scan(i: int, a: Atom, at=at) -> Relation:
                        name = a.predicate.name
                        if name not in names:
                            return self.relation(a)
                        if i == at:
                            return Relation(delta[name], self.kinds[name])
                        # positions before the delta see old facts only, so that no pair of facts is joined twice
                        return all_parts(name, old[name] if i < at else parts[name])

                    found[r.head.predicate.name].append(derive(self.spark, r, scan, self.kinds, at))
            new: dict[str, DataFrame] = {}
            for name, derivations in found.items():
                if any(d.facts is not None for d in derivations):
                    df = self.made(name, derivations)
                    df = _minus(df, _union(parts[name]), len(self.kinds[name]), rows[name]) if parts[name] else df
                    new[name] = settle(df)
            self.probe()
            old = {n: list(p) for n, p in parts.items()}
            found_rows = {n: df.count() for n, df in new.items()}
            rows = {n: r + found_rows.get(n, 0) for n, r in rows.items()}
            delta = {n: df for n, df in new.items() if found_rows[n]}
            self.model.rounds = max(self.model.rounds, number)
            if not delta:
                break
            for name, df in delta.items():
                parts[name].append(df)
                if len(parts[name]) > MERGE_EVERY:
                    merged = settle(_union(parts[name][:-1]).coalesce(max(1, parts[name][0].rdd.getNumPartitions())))
                    parts[name] = [merged, df]
                    old[name] = [merged]
            if number == LEAP_AFTER and len(names) == 1 and (step := step_of(rules, names[0], self.kinds)):
                number = self.leap(step, names[0], parts[names[0]], delta, rows, number)
                if not delta:
                    break
            number += 1
        for name in names:
            self.model.derived[name] = all_parts(name, parts[name])

    def pairs(self, step: Step, known: int) -> DataFrame | None:
        """All pairs of one step; None where they or those of more steps could be far more than the facts."""
        atoms = [a for _, a in step.rule.positives()]
        if len(atoms) == 2:
            room = known + sum(self.relation(a).df.count() for a in atoms)
            if join_size(step.rule, lambda _, a: self.relation(a), step.kinds) > MOST_PAIRS * room:
                return None
        facts = derive(self.spark, step.rule, lambda _, a: self.relation(a), step.kinds).facts
        if facts is None:
            return None
        pairs = settle(facts.distinct())
        return pairs if step.one_to_many(pairs, pairs.count()) else None

    def leap(self, step: Step, name: str, parts: list[DataFrame], delta: dict[str, DataFrame], rows: dict[str, int], number: int) -> int:
        """Goes on after round number, of which delta has the new facts: a leap takes all facts since by as many steps as
        led to them and one more. Adds to parts; gives the number of the last round that it stands for, and clears delta
        when nothing is left. Otherwise (no pairs, or the next leap may go beyond safety_rounds) rounds go on from delta."""
        size, done = 1, number
        if done + 1 > self.limits.safety_rounds or (pairs := self.pairs(step, rows[name])) is None:
            return done
        since, arity, few = [delta[name]], len(self.kinds[name]), False
        while done + size <= self.limits.safety_rounds:
            df = step.ahead(_union(since), pairs).distinct()
            new = settle(_minus(df, _union(parts), arity, rows[name] if few else 0))
            found = new.count()
            if not found:
                delta.clear()
                return done
            parts.append(new)
            since.append(new)
            rows[name] += found
            few = found * FEW_NEW < rows[name]
            done += size
            self.model.rounds = max(self.model.rounds, done)
            pairs, size = settle(step.twice(pairs)), size * 2
        delta[name] = _union(since)
        return done

    def in_rounds(self, rules: tuple[Rule, ...]) -> None:
        """All predicates of the stratum at once; a round sees only facts of earlier rounds. Without negation anywhere the
        last round that may bring facts is limits.fixpoint_depth - 2, with it one more, and that per stratum."""
        names = sorted({r.head.predicate.name for r in rules})
        known: dict[str, list[DataFrame]] = {n: [] for n in names}
        delta: dict[str, DataFrame] = {}
        last = self.limits.fixpoint_depth - (1 if self.program.negation else 2)
        for number in itertools.count():
            found: dict[str, list[Derivation]] = {n: [] for n in names}
            now = {n: Relation(_union(p), self.kinds[n]) if p else empty(self.spark, self.kinds[n]) for n, p in known.items()}
            for r in rules:
                inside = [i for i, a in r.positives() if a.predicate.name in names]
                for at in inside if number else [None]:
                    if number and r.body[at].atom.predicate.name not in delta:
                        continue

                    def scan(i: int, a: Atom, at=at) -> Relation:
                        name = a.predicate.name
                        if name not in names:
                            return self.relation(a)
                        return Relation(delta[name], self.kinds[name]) if i == at else now[name]

                    found[r.head.predicate.name].append(derive(self.spark, r, scan, self.kinds, at))
            new = {}
            for name, derivations in found.items():
                if any(d.facts is not None for d in derivations):
                    df = self.made(name, derivations)
                    df = settle(_minus(df, now[name].df, len(self.kinds[name])))
                    if n := df.count():
                        new[name] = df
                        self.model.counts[name] = self.model.counts.get(name, 0) + n
            self.probe()
            self.check_caps()
            if not new:
                break
            if number > last:
                raise DatalogError(Code.PAYLOAD_TOO_LARGE, "fixpoint depth exceeded", category="max_depth", deny_reason="DENY_MAX_DEPTH")
            delta = new
            for name, df in new.items():
                known[name].append(df)
            self.model.rounds = max(self.model.rounds, number)
        for name in names:
            self.model.derived[name] = Relation(_union(known[name]), self.kinds[name]) if known[name] else empty(self.spark, self.kinds[name])


def solve(spark: SparkSession, program: Program, base: dict[str, Relation], limits: Limits) -> Model:
    return Solver(spark, program, base, limits).run()
