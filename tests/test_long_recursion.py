"""Long recursions go on in leaps, and repeated base facts multiply nothing."""

import dataclasses
import random

import pytest

from policylog import UNBOUNDED, Code, DatalogError, Engine, Kind, Predicate
from policylog.operators import fixpoint

E, I, Q = Kind.EDB, Kind.IDB, Kind.QUERY
TURNS = 'first(C, T) :- turn(C, T, "user"). chain(C, T, T) :- first(C, T). chain(C, S, U) :- chain(C, S, T), next(T, U), turn(C, U, _).'
TC = "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z)."


@pytest.fixture
def settled(monkeypatch):
    """What has been computed on the way."""
    found, real = [], fixpoint.settle
    monkeypatch.setattr(fixpoint, "settle", lambda df: found.append(real(df)) or found[-1])
    return found


def solve(spark, program, limits=UNBOUNDED, **frames):
    engine = Engine(spark, limits)
    arity = {"turn": 3, "chain": 3, "first": 2, "next": 2, "edge": 2, "path": 2, "reach": 1, "shut": 1, "link": 2}
    engine.register_domain("d", [Predicate(n, k, (I if n in ("chain", "first", "path", "reach") else E) | Q) for n, k in arity.items() if f"{n}(" in program])
    edb = (ruleset := engine.load_inline_ruleset("d", "long", program.replace('"user"', "0"))).edb()
    for name, df in frames.items():
        edb.add_dataframe(name, df)
    return ruleset.solve(edb)


def facts(result, name):
    got = [tuple(r) for r in result.relation(name).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_turns_of_long_conversations(spark, settled):
    """Chains of 150 turns took 150 rounds, and each turn met as many rows of next as conversations have that turn."""
    turns = [(c, t, t % 2) for c in range(40) for t in range(150 if c == 7 else 3 + c % 5) if (c, t) != (3, 4)]
    df = spark.createDataFrame(turns, "c long, t long, r long")
    got = solve(spark, TURNS, turn=df, next=df.selectExpr("t", "t + 1"))
    there = {(c, t) for c, t, _ in turns}
    want = set()
    for c, t, r in turns:
        u = t
        while r == 0 and (c, u) in there:
            want.add((c, t, u))
            u += 1
    assert facts(got, "chain") == want
    assert len(settled) <= 30
    assert all(d.count() == d.distinct().count() for d in settled)


GRAPHS = {
    "line": [(i, i + 1) for i in range(70)],
    "ring and tails": [(i, (i + 1) % 23) for i in range(23)] + [(100 + i, 101 + i if i < 12 else 5) for i in range(13)],
    "tree downwards": [(i // 2, i) for i in range(1, 90)] + [(1000 + i, 1001 + i) for i in range(20)],
    "any": [(random.Random(i).randrange(30), random.Random(-i).randrange(30)) for i in range(25)] + [(40 + i, 41 + i) for i in range(12)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("scan_known", [fixpoint.SCAN_KNOWN, 0])
def test_closures_of_long_graphs(spark, name, scan_known, monkeypatch):
    monkeypatch.setattr(fixpoint, "SCAN_KNOWN", scan_known)
    edges = set(GRAPHS[name])
    want, grown = set(edges), True
    while grown:
        more = {(x, z) for x, y in want for a, z in edges if a == y} - want
        want, grown = want | more, bool(more)
    assert facts(solve(spark, TC, edge=spark.createDataFrame([*edges] * 2, "a long, b long")), "path") == want


def test_negated_atoms_and_terms_that_move_on(spark, settled):
    """reach stops before what is shut; path slides as a window of two over a line."""
    line = spark.range(80).selectExpr("id", "id + 1")
    shut = spark.createDataFrame([(60,)], "n long")
    got = solve(spark, "reach(0) :- edge(0, _). reach(Z) :- reach(Y), edge(Y, Z), not(shut(Z)).", edge=line, shut=shut)
    assert facts(got, "reach") == {(i,) for i in range(60)} and len(settled) < 25
    got = solve(spark, "path(X, Y) :- link(X, Y). path(Y, Z) :- path(X, Y), edge(Y, Z).", edge=line, link=spark.createDataFrame([(0, 1), (7, 7)], "a long, b long"))
    assert facts(got, "path") == {(i, i + 1) for i in range(80)} | {(7, 7)}


def test_pairs_that_would_be_too_many_are_not_made(spark, settled):
    """Without the facts of reach, the recursive rule's two atoms give 250,000 pairs; with them it goes round by round."""
    hub = spark.range(500).selectExpr("id + 1000", "0L").union(spark.range(12).selectExpr("id", "id + 1"))
    spokes = spark.range(500).selectExpr("0L", "id + 5000").union(spark.range(13).selectExpr("id + 1", "id + 1"))
    got = solve(spark, "reach(0) :- edge(0, _). reach(Z) :- reach(X), edge(X, Y), link(Y, Z).", edge=hub, link=spokes)
    assert facts(got, "reach") == {(i,) for i in range(13)}
    assert max(d.count() for d in settled) < 1000


@pytest.mark.parametrize("most,fails", [(13, True), (19, True), (20, False), (40, False)])
def test_the_limit_of_rounds_counts_steps(spark, most, fails):
    """Paths of 20 edges come in round 19; round 20 finds that there are no more."""
    edges = spark.range(20).selectExpr("id", "id + 1")
    limits = dataclasses.replace(UNBOUNDED, safety_rounds=most)
    if fails:
        with pytest.raises(DatalogError) as e:
            solve(spark, TC, limits, edge=edges)
        assert e.value.code == Code.PAYLOAD_TOO_LARGE and e.value.category == "max_depth"
    else:
        assert solve(spark, TC, limits, edge=edges).relation("path").count() == 210
