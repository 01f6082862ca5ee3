"""Solving, querying and explaining."""

import itertools
import random

import pytest

from policylog import LARGE, SMALL, UNBOUNDED, Code, DatalogError, Decision, DomainAlreadyRegisteredError, Engine, Kind, Predicate, decide, load_manifest
from policylog.functions.decision import decision_column
from policylog.sources.manifest import load_manifest_file

E, P, I, Q = Kind.EDB, Kind.POLICY_FACT, Kind.IDB, Kind.QUERY
TABLE = [("edge", 2, E | Q), ("q", 2, E), ("r", 2, E), ("val", 1, E), ("safe", 1, P | Q), ("path", 2, I | Q), ("p", 1, I | Q), ("left", 1, I | Q), ("right", 1, I | Q), ("both", 1, I | Q), ("hidden", 1, I), ("flag", 0, I | Q)]


def domain(r):
    for p in TABLE:
        r.add(Predicate(*p))
    for a in ("a", "b", "alice"):
        r.add_atom(a)


def solved(spark, program, facts, limits=UNBOUNDED, frames=()):
    engine = Engine(spark, limits)
    engine.register_domain("d", domain)
    ruleset = engine.load_inline_ruleset("d", "policy", program)
    edb = ruleset.edb()
    for name, *terms in facts:
        edb.add_fact(name, *terms)
    for name, df in frames:
        edb.add_dataframe(name, df)
    return ruleset.solve(edb)


def rows(df):
    plain = lambda v: next(x for x in (v.s, v.i, v.b) if x is not None) if hasattr(v, "kind") else v
    return sorted(tuple(map(plain, r)) for r in df.collect())


TC = "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z)."


@pytest.mark.parametrize("limits", [UNBOUNDED, SMALL])
def test_closure(spark, limits):
    r = solved(spark, TC, [("edge", "a", "b"), ("edge", "b", "c"), ("edge", "b", "c")], limits)
    assert rows(r.relation("path")) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert r.derived_fact_count == 3 and r.contains_fact("path", "a", "c") and not r.contains_fact("path", "c", "a")
    assert not r.contains_fact("path", "never", "seen") and r.contains_fact("edge", "a", "b")
    assert r.count("edge") == 0, "base predicates enumerate as empty"
    found, total = r.enumerate_capacity("path", 2)
    assert len(found) == 2 and total == 3 and r.enumerate_capacity("path", 0) == ([], 3)


@pytest.mark.parametrize("seed", range(3))
def test_recursion_equals_naive(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr("policylog.operators.fixpoint.SCAN_KNOWN", 0)
    rng = random.Random(seed)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(12)}
    want, grown = set(edges), True
    while grown:
        more = {(a, d) for a, b in want for c, d in want if b == c} - want
        want, grown = want | more, bool(more)
    facts = [("edge", *e) for e in edges]
    for program in (TC, "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), path(Y, Z)."):
        assert rows(solved(spark, program, facts).relation("path")) == sorted(want)


def test_layers_negation_and_anonymous(spark):
    facts = [("q", 1, "a"), ("q", 2, "a"), ("r", 2, "a")]
    r = solved(spark, 'left(X) :- r(X,"a"). right(X) :- q(X,"a"), not(left(X)). both(X) :- left(X), q(X, _). p(X) :- q(X, "a"), not(r(X, "a")).', facts)
    assert [rows(r.relation(n)) for n in ("left", "right", "both", "p")] == [[(2,)], [(1,)], [(2,)], [(1,)]]


def test_mixed_kinds_join_by_kind(spark):
    facts = [("val", 1), ("val", "1"), ("val", True), ("edge", 1, "x"), ("edge", "1", "y"), ("q", 1, "z")]
    r = solved(spark, "p(Y) :- val(X), edge(X, Y). left(X) :- val(X), q(X, _). right(X) :- val(X), not(left(X)).", facts)
    assert rows(r.relation("p")) == [("x",), ("y",)] and rows(r.relation("left")) == [(1,)]
    assert r.count("right") == 2 and r.contains_fact("right", "1") and r.contains_fact("right", True) and not r.contains_fact("right", 1)


def test_comparisons_fail_closed_only_on_joined_rows(spark):
    ok = [("q", 1, "a"), ("val", "alice")]
    assert rows(solved(spark, "p(X) :- q(X, _), X > 0.", ok).relation("p")) == [(1,)]
    with pytest.raises(DatalogError) as e:
        solved(spark, "p(X) :- q(X, _), X > 0.", [*ok, ("q", "alice", "b")])
    assert e.value.code == Code.INVALID_FIELD and e.value.category == "comparison_type_error"
    assert rows(solved(spark, "p(X) :- q(X, _), r(X, _), X > 0.", [*ok, ("q", "alice", "b"), ("r", 1, "b")]).relation("p")) == [(1,)]
    assert rows(solved(spark, "p(X) :- q(X, _), not(val(X)), X > 0.", [*ok, ("q", "alice", "b")]).relation("p")) == [(1,)]
    with pytest.raises(DatalogError):
        solved(spark, "p(X) :- q(X, _), X * 2147483647 * 2147483647 * 4 > 0.", ok)


KIND_SAMPLES = [1, 2, "a", "b", True, False]


def test_comparison_matrix(spark):
    """Every operator on every pair of kinds, against the rule in words."""
    for op, (x, y) in itertools.product(("=", "<", ">="), itertools.product([1, "a", True], [2, "a", True])):
        fails = type(x) is not type(y) or op != "=" and type(x) is not int
        run = lambda: solved(spark, f"p(X) :- q(X, Y), X {op} Y.", [("q", x, y)]).count("p")  # noqa: B023, E731
        if fails:
            with pytest.raises(DatalogError):
                run()
        else:
            assert run() == {"=": x == y, "<": x < y, ">=": x >= y}[op]


def test_depth_limit_of_both_ways(spark):
    chain = lambda n: [("q", 0, "a"), *(("edge", i, i + 1) for i in range(n))]
    program = "p(X) :- q(X, _). p(Y) :- p(X), edge(X, Y)."
    assert solved(spark, program, chain(8), SMALL).count("p") == 9
    with pytest.raises(DatalogError) as e:
        solved(spark, program, chain(9), SMALL)
    assert (e.value.code, e.value.category) == (Code.PAYLOAD_TOO_LARGE, "max_depth")
    stratified = program + ' left(X) :- q(X, _), not(safe("a")).'
    assert solved(spark, stratified, chain(9), SMALL).count("p") == 10
    with pytest.raises(DatalogError):
        solved(spark, stratified, chain(10), SMALL)
    assert solved(spark, program, chain(30)).count("p") == 31


def test_capacities(spark):
    with pytest.raises(DatalogError):
        solved(spark, "", [("edge", i, i) for i in range(65)], SMALL)
    with pytest.raises(DatalogError) as e:
        solved(spark, "path(X, Y) :- edge(X, _), edge(Y, _).", [("edge", i, i) for i in range(9)], SMALL)
    assert e.value.category == "idb_overflow"
    assert solved(spark, "path(X, Y) :- edge(X, _), edge(Y, _).", [("edge", i, i) for i in range(9)], LARGE).count("path") == 81


def test_dataframes_zero_arity_and_rules_without_atoms(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "x int, x2 short")
    r = solved(spark, 'flag() :- edge(_, _). left(X) :- edge(X, _), flag(). right(1) :- 1 < 2, not(safe("a")). both("a") :- not(flag()).', [], frames=[("edge", df)])
    assert rows(r.relation("left")) == [(1,), (2,)] and rows(r.relation("right")) == [(1,)] and r.count("both") == 0
    assert r.contains_fact("flag")
    asked = r.contains_batch("left", spark.createDataFrame([(1,), (9,), (None,)], "n int"))
    assert asked.columns == ["n", "contained"] and {tuple(x) for x in asked.collect()} == {(1, True), (9, False), (None, False)}
    assert not any(x.contained for x in r.contains_batch("left", spark.createDataFrame([("1",)], "n string")).collect())
    assert solved(spark, TC, []).derived_fact_count == 0
    with pytest.raises(DatalogError):
        solved(spark, "", [], frames=[("edge", spark.createDataFrame([(1.5, 2)], "a double, b int"))])


def test_query_checks(spark):
    r = solved(spark, 'safe("a"). hidden(X) :- edge(X, _). p(X) :- hidden(X).', [("edge", 1, 2)])
    assert r.contains_fact("safe", "a") and not r.contains_fact("safe", "b")
    for bad in (("hidden", 1), ("nobody", 1), ("p", 1, 2), ("p", 1.5)):
        with pytest.raises(DatalogError) as e:
            r.contains_fact(*bad)
        assert e.value.code == Code.INVALID_FIELD
    r.ruleset.whitelist = {("path", 2)}
    with pytest.raises(DatalogError) as e:
        r.relation("p")
    assert e.value.code == Code.FORBIDDEN


def test_edb_rules(spark):
    engine = Engine(spark, SMALL)
    engine.register_domain("d", domain)
    edb = engine.load_inline_ruleset("d", "x", "").edb()
    for name, terms, code in (("safe", ("a",), Code.FORBIDDEN), ("p", (1,), Code.INVALID_FIELD), ("edge", (1,), Code.INVALID_FIELD)):
        with pytest.raises(DatalogError) as e:
            edb.add_fact(name, *terms)
        assert e.value.code == code
    with pytest.raises(DatalogError):
        edb.add_atom("val", "unheard")
    edb.add_atom("val", "alice")
    with pytest.raises(DatalogError):
        edb.add_facts("edge", [(i, i) for i in range(65)])
    edb.add_facts("edge", [])
    edb.finalize()
    with pytest.raises(DatalogError) as e:
        edb.add_fact("val", 1)
    assert e.value.code == Code.INVALID_STATE


def test_domains(spark):
    with Engine(spark) as engine:
        engine.register_domain("d", [Predicate("a", 1, E)])
        engine.register_domain("d", [Predicate("a", 1, E)])
        with pytest.raises(DomainAlreadyRegisteredError):
            engine.register_domain("d", [Predicate("a", 2, E)])
        with pytest.raises(DatalogError):
            engine.load_inline_ruleset("none", "x", "")
    with pytest.raises(DatalogError):
        engine.register_domain("e", [])


def test_decisions(spark):
    names = {(0, 0, 0): "deny_default", (0, 0, 1): "allow", (0, 1, 0): "reduced", (0, 1, 1): "reduced", (1, 0, 0): "deny", (1, 0, 1): "deny_conflict", (1, 1, 0): "deny_conflict", (1, 1, 1): "deny_conflict"}
    df = spark.createDataFrame([tuple(map(bool, k)) for k in names], "d boolean, r boolean, a boolean")
    got = {tuple(map(int, x[:3])): x[3] for x in df.select("*", decision_column(df.d, df.r, df.a)).collect()}
    assert got == names == {k: decide(*k).text for k in names} and Decision.DENY_CONFLICT == 4


def test_explanation_text(spark):
    r = solved(spark, TC + " left(X) :- path(X, Y), not(safe(X)), Y + 1 > 3.", [("edge", 1, 2), ("edge", 2, 3)])
    assert r.explain_fact_text("left", 1) == (
        "POLICYLOG-v2\ndocument=why-true\nstatus=complete\nsteps=3 premises=6\n"
        'step=0 rule=1 fact="path"(1,2)\npremise=0 body=0 kind=positive origin=edb fact="edge"(1,2) parent=-\n'
        'step=1 rule=2 fact="path"(1,3)\npremise=1 body=0 kind=positive origin=idb fact="path"(1,2) parent=0\npremise=2 body=1 kind=positive origin=edb fact="edge"(2,3) parent=-\n'
        'step=2 rule=3 fact="left"(1)\npremise=3 body=0 kind=positive origin=idb fact="path"(1,3) parent=1\npremise=4 body=1 kind=negative-absence origin=policy-fact fact="safe"(1) parent=-\n'
        "premise=5 body=2 kind=comparison-true origin=none lhs=4 op=> rhs=3 parent=-\nresult-step=2\n")
    assert r.explain_fact_text("left", 7) is None and r.explain_document("edge", 1, 2).splitlines()[2] == "status=not-derived"
    assert [n.fact[0] for n in r.proof_of("path", 1, 3)] == ["path", "path"]
    long = solved(spark, TC, [("edge", i, j) for i in range(9) for j in range(9) if j == i + 1] + [("edge", 9 + i, 10 + i) for i in range(40)])
    assert "status=truncated" in long.explain_document("path", 9, 49)


def test_explanations_agree_with_solving(spark):
    rng = random.Random(4)
    facts = [("edge", rng.randrange(7), rng.randrange(7)) for _ in range(9)]
    r = solved(spark, TC, facts)
    assert {f for f in r.trace.witness} == {("path", tuple(map(__import__("policylog.functions.terms", fromlist=["const"]).const, x))) for x in rows(r.relation("path"))}


def manifest(**more):
    import hashlib
    import json

    entry = {"policy_id": "one", "domain": "d", "file": "one.dl", "sha256": hashlib.sha256(TC.encode()).hexdigest(), "mode": "enforce", "description": "", "enabled": True, "idb_predicates": ["ignored"], "queries": [{"name": "path", "arity": 2}]} | more
    root = {"policy_set_id": "s", "policy_set_version": "1", "manifest_version": "1", "default_profile": "POLICYLOG-v2", "created_for": "test", "policies": [entry], "capabilities": [], "strict_loading": True, "fail_closed": True}
    return root, json.dumps


def test_manifests(spark, tmp_path):
    engine = Engine(spark)
    engine.register_domain("d", domain)
    root, dumps = manifest()
    found = load_manifest(engine, dumps(root), {"one.dl": TC})
    assert found.queries == {("path", 2)} and found.rulesets[0].whitelist == {("path", 2)}
    for more, code in (({"mode": "test_only"}, "MANIFEST_TEST_ONLY_REJECTED"), ({"mode": "x"}, "MANIFEST_INVALID_FIELD"), ({"sha256": "0" * 64}, "MANIFEST_SHA_MISMATCH"), ({"file": "two.dl"}, "MANIFEST_POLICY_NOT_FOUND"),
                       ({"domain": "x"}, "MANIFEST_UNKNOWN_DOMAIN"), ({"extra": 1}, "MANIFEST_UNKNOWN_FIELD"), ({"enabled": 1}, "MANIFEST_INVALID_FIELD"), ({"queries": [{"name": "hidden", "arity": 1}]}, "REGISTRY_CONFLICT")):
        with pytest.raises(DatalogError) as e:
            load_manifest(engine, dumps(manifest(**more)[0]), {"one.dl": TC})
        assert e.value.diagnostic.code == code
    with pytest.raises(DatalogError):
        load_manifest(engine, "{", {})
    assert load_manifest(engine, dumps(manifest(enabled=False)[0]), {}).rulesets == []
    (tmp_path / "m.json").write_text(dumps(root | {"default_profile": "enforce"}))
    (tmp_path / "one.dl").write_text(TC)
    assert len(load_manifest_file(engine, tmp_path / "m.json").rulesets) == 1
    (tmp_path / "m.json").write_text(dumps(manifest(file="../one.dl")[0] | {"default_profile": "enforce"}))
    with pytest.raises(DatalogError) as e:
        load_manifest_file(engine, tmp_path / "m.json")
    assert e.value.code == Code.FORBIDDEN


def test_streamed_batches(spark, tmp_path):
    from policylog.streaming import solve_each_batch

    engine = Engine(spark)
    engine.register_domain("d", domain)
    ruleset = engine.load_inline_ruleset("d", "x", TC)
    spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    writer = solve_each_batch(stream, ruleset, "edge", lambda edb: edb.add_fact("edge", 3, 4), lambda r, n: seen.append(r.count("path")))
    writer.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [6]


@pytest.mark.parametrize("program,rows,code", [("p(X) :- e(X, _).", [("a", 1), ("b", None)], Code.INVALID_FIELD), ("p(X) :- e(X, _).", [("x" * 1025, 1)], Code.PAYLOAD_TOO_LARGE)])
def test_facts_of_dataframes_fail_closed(spark, program, rows, code):
    engine = Engine(spark)
    engine.register_domain("d", [Predicate("e", 2, Kind.EDB), Predicate("p", 1, Kind.IDB | Kind.QUERY)])
    edb = (ruleset := engine.load_inline_ruleset("d", "closed", program)).edb()
    edb.add_dataframe("e", spark.createDataFrame(rows, "s string, n long"))
    with pytest.raises(DatalogError) as caught:
        ruleset.solve(edb)
    assert caught.value.code == code and caught.value.category == "malformed_edb"


def test_relations_with_several_readers_are_computed_once(spark):
    """Each step reads the one before twice; planned anew for each reader, the last would hold 2^6 scans."""
    steps = 6
    engine = Engine(spark)
    engine.register_domain("steps", [Predicate("edge", 2, E), *[Predicate(f"leap{n}", 2, I | Q) for n in range(steps + 1)]])
    rules = "leap0(X, Y) :- edge(X, Y)." + "".join(f" leap{n + 1}(X, Z) :- leap{n}(X, Y), leap{n}(Y, Z)." for n in range(steps))
    ruleset = engine.load_inline_ruleset("steps", "leaps", rules)
    edb = ruleset.edb()
    edb.add_dataframe("edge", spark.range(66).selectExpr("id", "id + 1"))
    leaps = ruleset.solve(edb).relation(f"leap{steps}")
    assert rows(leaps) == [(0, 64), (1, 65), (2, 66)]
    assert leaps._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_recursion_reads_its_inputs_once(spark):
    """What a recursive rule reads from outside is computed before the first round, not in every one."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.range(0, 12, 1, 1).selectExpr("id as a", "id + 1 as b").mapInArrow(counted, "a long, b long")
    r = solved(spark, TC, [], frames=[("edge", edges)])
    assert r.relation("path").count() == 78
    assert seen.value <= 36  # the check of facts, the first rule, the recursive one; there are 12 rounds


def test_numbers_of_symbols_and_clearing(spark):
    engine = Engine(spark)
    engine.register_domain("d", domain)
    ruleset = engine.load_inline_ruleset("d", "x", TC)
    edb = ruleset.edb()
    a, b = edb.intern_symbol("a"), edb.intern_symbol("b")
    assert (a, b, edb.intern_symbol("a")) == (1, 2, 1) and ruleset.symbol_text(b) == "b" and ruleset.symbol_text(0) is None
    edb.add_symbol_id_facts("edge", [(a, b), (b, a), (a, b)])
    with pytest.raises(DatalogError) as e:
        edb.add_symbol_id_facts("edge", [(b, b), (a, 9)])
    assert e.value.code == Code.INVALID_ARGUMENT
    before = ruleset.solve(edb)
    assert rows(before.canonical("path")) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    with pytest.raises(DatalogError) as e:
        edb.intern_symbol("c")
    assert e.value.code == Code.INVALID_STATE
    edb.clear()
    edb.add_symbol_ids("edge", a, a)
    assert rows(ruleset.solve(edb).relation("path")) == [("a", "a")] and before.count("path") == 4


def test_canonical_order_is_by_kind_then_value(spark):
    r = solved(spark, "p(X) :- val(X).", [("val", v) for v in (True, 10, "b", 9, "a", False)])
    assert [next(x for x in v[0][1:] if x is not None) for v in r.canonical("p").collect()] == ["a", "b", 9, 10, False, True]
