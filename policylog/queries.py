"""The registered queries of the rule engine: small programs over the test tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylog import surface_queries
from policylog.engine import Engine, SolveResult
from policylog.functions.decision import decision_column
from policylog.limits import LARGE, SMALL
from policylog.registry import Kind, Predicate, Registry
from policylog.surface_queries import status

#: Base predicates: table and the expressions of its terms. Prices are floored before the cast, as casts round differently.
BASE: dict[str, tuple[str, tuple[str, ...]]] = {
    "region": ("region", ("cast(r_regionkey as bigint)", "r_name")),
    "nation": ("nation", ("cast(n_nationkey as bigint)", "n_name", "cast(n_regionkey as bigint)")),
    "customer": ("customer", ("c_custkey", "cast(c_nationkey as bigint)", "c_mktsegment")),
    "supplier": ("supplier", ("s_suppkey", "cast(s_nationkey as bigint)")),
    "ord": ("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")),
    "price": ("orders", ("o_orderkey", "cast(floor(o_totalprice) as bigint)")),
    "item": ("lineitem", ("l_orderkey", "cast(l_linenumber as bigint)", "cast(floor(l_quantity) as bigint)", "cast(round(l_discount * 100) as bigint)")),
    "part": ("part", ("p_partkey", "p_brand", "p_type", "cast(p_size as bigint)")),
    "label": ("labels", ("doc_id", "quality = 1", "toxic = 1")),
    "turn": ("conversations", ("conv_id", "turn", "role")),
    "next": ("conversations", ("turn", "turn + 1")),
    "ring": ("nation", ("cast(n_nationkey as bigint)", "cast((n_nationkey + 1) % 25 as bigint)")),
    "hop": ("nation", ("cast(n_nationkey as bigint)", "cast((n_nationkey + 5) % 25 as bigint)")),
    "tree": ("part", ("p_partkey", "cast(floor(p_partkey / 2) as bigint)")),
}
ATOMS = ("ASIA", "AFRICA", "EUROPE", "BUILDING", "MACHINERY", "O", "F", "P", "1-URGENT", "5-LOW", "user", "assistant", "system")


@dataclass(frozen=True)
class Query:
    program: str
    derived: dict[str, int]
    out: str
    columns: tuple[str, ...]
    sql: str | None
    policy: dict[str, int] | None = None


def solve(spark: SparkSession, sf_dir: str, program: str, derived: dict[str, int], policy: dict[str, int] | None = None, limits=None) -> SolveResult:
    """Only base predicates that the program names are read, and only their columns."""
    used = {n for n in BASE if f"{n}(" in program}

    def domain(r: Registry) -> None:
        for n in sorted(used):
            r.add(Predicate(n, len(BASE[n][1]), Kind.EDB | Kind.QUERY))
        for n, arity in (policy or {}).items():
            r.add(Predicate(n, arity, Kind.POLICY_FACT | Kind.QUERY))
        for n, arity in derived.items():
            r.add(Predicate(n, arity, Kind.IDB | Kind.QUERY))
        for a in ATOMS:
            r.add_atom(a)

    engine = Engine(spark) if limits is None else Engine(spark, limits)
    engine.register_domain("bench", domain)
    ruleset = engine.load_inline_ruleset("bench", "query", program)
    edb = ruleset.edb()
    for n in used:
        table, terms = BASE[n]
        edb.add_dataframe(n, spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{t} as t{i}" for i, t in enumerate(terms)]))
    return ruleset.solve(edb)


def _run(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = solve(spark, sf_dir, q.program, q.derived, q.policy).relation(q.out)
        return df.toDF(*q.columns) if q.columns else df

    return run


def _view(name: str, *columns: str) -> str:
    table, terms = BASE[name]
    return "(SELECT DISTINCT " + ", ".join(f"{t.replace('/ 2', '/ 2.0')} AS {c}" for t, c in zip(terms, columns)) + f" FROM {table}) {name}"


R, N, C, S, O, I, P, L = (_view("region", "r", "rn"), _view("nation", "n", "nn", "r"), _view("customer", "c", "n", "seg"), _view("supplier", "s", "n"),
                          _view("ord", "o", "c", "st", "pr"), _view("item", "o", "l", "q", "d"), _view("part", "p", "b", "t", "z"), _view("label", "d", "q", "x"))
PR, RING, HOP, TREE = _view("price", "o", "v"), _view("ring", "a", "b"), _view("hop", "a", "b"), _view("tree", "p", "q")

PROGRAMS: dict[str, Query] = {
    "scan_project": Query("big(K) :- ord(K, _, _, _).", {"big": 1}, "big", ("o",), f"SELECT DISTINCT o FROM {O}"),
    "const_select": Query('asia(N) :- nation(N, _, R), region(R, "ASIA").', {"asia": 1}, "asia", ("n",), f"SELECT DISTINCT n FROM {N} JOIN {R} USING (r) WHERE rn = 'ASIA'"),
    "self_equal": Query("loop(X) :- step(X, X). step(X, Y) :- tree(X, Y). step(X, X) :- part(X, _, _, 15).", {"loop": 1, "step": 2}, "loop", ("x",), f"SELECT p AS x FROM {TREE} WHERE p = q UNION SELECT p FROM {P} WHERE z = 15"),
    "join3": Query("seat(C, M, R) :- customer(C, N, _), nation(N, M, K), region(K, R).", {"seat": 3}, "seat", ("c", "nn", "rn"), f"SELECT DISTINCT c, nn, rn FROM {C} JOIN {N} USING (n) JOIN {R} USING (r)"),
    "cross_product": Query("pair(A, B) :- region(A, _), region(B, _).", {"pair": 2}, "pair", ("a", "b"), f"SELECT DISTINCT region.r AS a, x.r AS b FROM {R}, (SELECT r_regionkey::BIGINT AS r FROM region) x"),
    "self_join": Query("same(A, B) :- supplier(A, N), supplier(B, N), A < B.", {"same": 2}, "same", ("a", "b"), f"SELECT DISTINCT supplier.s AS a, x.s AS b FROM {S} JOIN (SELECT s_suppkey AS s, s_nationkey::BIGINT AS n FROM supplier) x USING (n) WHERE supplier.s < x.s"),
    "semi_join": Query("buys(C) :- customer(C, _, _), ord(_, C, _, _).", {"buys": 1}, "buys", ("c",), f"SELECT DISTINCT c FROM {C} SEMI JOIN {O} USING (c)"),
    "arith_paren": Query("hit(O, L) :- item(O, L, Q, D), (Q + D) * 2 < 30.", {"hit": 2}, "hit", ("o", "l"), f"SELECT DISTINCT o, l FROM {I} WHERE (q + d) * 2 < 30"),
    "arith_add": Query("hit(O, L) :- item(O, L, Q, D), Q + D >= 50.", {"hit": 2}, "hit", ("o", "l"), f"SELECT DISTINCT o, l FROM {I} WHERE q + d >= 50"),
    "arith_sub": Query("hit(O, L) :- item(O, L, Q, D), Q - D < 0.", {"hit": 2}, "hit", ("o", "l"), f"SELECT DISTINCT o, l FROM {I} WHERE q - d < 0"),
    "arith_mul": Query("hit(O, L) :- item(O, L, Q, D), Q * D = L * 12.", {"hit": 2}, "hit", ("o", "l"), f"SELECT DISTINCT o, l FROM {I} WHERE q * d = l * 12"),
    "cmp_bool": Query("good(D) :- label(D, Q, T), Q = true, T != true.", {"good": 1}, "good", ("d",), f"SELECT DISTINCT d FROM {L} WHERE q AND NOT x"),
    "cmp_symbol": Query('other(C) :- customer(C, _, G), G != "BUILDING".', {"other": 1}, "other", ("c",), f"SELECT DISTINCT c FROM {C} WHERE seg <> 'BUILDING'"),
    "theta_join": Query("over(A, B) :- hop(A, B), ring(B, C), C > A.", {"over": 2}, "over", ("a", "b"), f"SELECT DISTINCT hop.a, hop.b FROM {HOP} JOIN {RING} ON hop.b = ring.a WHERE ring.b > hop.a"),
    "or_expand": Query('pick(O) :- ord(O, _, "O", _) or ord(O, _, _, "1-URGENT").', {"pick": 1}, "pick", ("o",), f"SELECT DISTINCT o FROM {O} WHERE st = 'O' OR pr = '1-URGENT'"),
    "or_cartesian": Query('pick(O, C) :- ord(O, C, "O", _) or ord(O, C, "F", _), customer(C, _, "BUILDING") or customer(C, _, "MACHINERY").', {"pick": 2}, "pick", ("o", "c"), f"SELECT DISTINCT o, c FROM {O} JOIN {C} USING (c) WHERE st IN ('O', 'F') AND seg IN ('BUILDING', 'MACHINERY')"),
    "union_rules": Query("key(K) :- customer(K, _, _). key(K) :- supplier(K, _). key(K) :- part(K, _, _, _).", {"key": 1}, "key", ("k",), f"SELECT c AS k FROM {C} UNION SELECT s FROM {S} UNION SELECT p FROM {P}"),
    "intersect_rules": Query("both(K) :- customer(K, _, _), supplier(K, _).", {"both": 1}, "both", ("k",), f"SELECT c AS k FROM {C} INTERSECT SELECT s FROM {S}"),
    "difference_rules": Query("only(K) :- customer(K, _, _), not(sup(K)). sup(K) :- supplier(K, _).", {"only": 1, "sup": 1}, "only", ("k",), f"SELECT c AS k FROM {C} EXCEPT SELECT s FROM {S}"),
    "anti_edb": Query("idle(C) :- customer(C, N, _), not(ring(N, 5)), not(supplier(C, N)).", {"idle": 1}, "idle", ("c",), f"SELECT DISTINCT c FROM {C} ANTI JOIN (SELECT s_suppkey AS c, s_nationkey::BIGINT AS n FROM supplier) x USING (c, n) WHERE n NOT IN (SELECT a FROM {RING} WHERE b = 5)"),
    "anti_policy": Query('banned("BUILDING"). ok(C) :- customer(C, _, G), not(banned(G)).', {"ok": 1}, "ok", ("c",), f"SELECT DISTINCT c FROM {C} WHERE seg <> 'BUILDING'", {"banned": 1}),
    "anti_idb": Query('urgent(C) :- ord(_, C, "P", "1-URGENT"). idle(C) :- customer(C, _, _), not(urgent(C)).', {"urgent": 1, "idle": 1}, "idle", ("c",), f"SELECT DISTINCT c FROM {C} WHERE c NOT IN (SELECT c FROM {O} WHERE st = 'P' AND pr = '1-URGENT')"),
    "strata3": Query("a(C) :- ord(_, C, _, _). b(C) :- customer(C, _, _), not(a(C)). d(C) :- customer(C, _, _), not(b(C)), not(e(C)). e(C) :- supplier(C, _).", {"a": 1, "b": 1, "d": 1, "e": 1}, "d", ("c",),
                     f"SELECT DISTINCT c FROM {C} SEMI JOIN {O} USING (c) WHERE c NOT IN (SELECT s_suppkey FROM supplier)"),
    "policy_facts": Query('fav("BUILDING", 1). fav("MACHINERY", 2). top(C, K) :- customer(C, _, G), fav(G, K).', {"top": 2}, "top", ("c", "k"), f"SELECT DISTINCT c, k FROM {C} JOIN (VALUES ('BUILDING', 1::BIGINT), ('MACHINERY', 2::BIGINT)) f(seg, k) USING (seg)", {"fav": 2}),
    "tc_linear": Query("up(X, Y) :- tree(X, Y). up(X, Z) :- up(X, Y), tree(Y, Z).", {"up": 2}, "up", ("x", "y"), f"WITH RECURSIVE t AS (SELECT p, q FROM {TREE}), u(x, y) AS (SELECT p, q FROM t UNION SELECT x, q FROM u JOIN t ON y = p) SELECT x, y FROM u"),
    "tc_nonlinear": Query("up(X, Y) :- hop(X, Y). up(X, Z) :- up(X, Y), up(Y, Z).", {"up": 2}, "up", ("x", "y"), f"WITH RECURSIVE t AS (SELECT a, b FROM {HOP}), u(x, y) AS (SELECT a, b FROM t UNION SELECT x, b FROM u JOIN t ON y = a) SELECT x, y FROM u"),
    "tc_cyclic": Query("up(X, Y) :- ring(X, Y). up(X, Z) :- up(X, Y), up(Y, Z).", {"up": 2}, "up", ("x", "y"), f"WITH RECURSIVE t AS (SELECT a, b FROM {RING}), u(x, y) AS (SELECT a, b FROM t UNION SELECT x, b FROM u JOIN t ON y = a) SELECT x, y FROM u"),
    "mutual_recursion": Query("odd(X, Y) :- tree(X, Y). odd(X, Z) :- even(X, Y), tree(Y, Z). even(X, Z) :- odd(X, Y), tree(Y, Z).", {"odd": 2, "even": 2}, "even", ("x", "y"),
                              f"WITH RECURSIVE t AS (SELECT p, q FROM {TREE}), u(x, y, o) AS (SELECT p, q, 1 FROM t UNION SELECT x, q, 1 - o FROM u JOIN t ON y = p) SELECT DISTINCT x, y FROM u WHERE o = 0"),
    "same_generation": Query("sg(X, Y) :- hop(X, Z), hop(Y, Z). sg(X, Y) :- hop(X, A), sg(A, B), hop(Y, B).", {"sg": 2}, "sg", ("x", "y"),
                             f"WITH RECURSIVE t AS (SELECT a, b FROM {HOP}), u(x, y) AS (SELECT l.a, r.a FROM t l JOIN t r ON l.b = r.b UNION SELECT l.a, r.a FROM u JOIN t l ON l.b = x JOIN t r ON r.b = y) SELECT x, y FROM u"),
    "recursion_then_negation": Query("reach(Y) :- hop(0, Y). reach(Z) :- reach(Y), hop(Y, Z). lost(X) :- hop(X, _), not(reach(X)).", {"reach": 1, "lost": 1}, "lost", ("x",),
                                     f"WITH RECURSIVE t AS (SELECT a, b FROM {HOP}), u(x) AS (SELECT b FROM t WHERE a = 0 UNION SELECT b FROM u JOIN t ON x = a) SELECT DISTINCT a AS x FROM t WHERE a NOT IN (SELECT x FROM u)"),
    "turn_chain": Query('first(C, T) :- turn(C, T, "user"). chain(C, T, T) :- first(C, T). chain(C, S, U) :- chain(C, S, T), next(T, U), turn(C, U, _).', {"first": 2, "chain": 3}, "chain", ("c", "s", "t"),
                        "SELECT DISTINCT a.conv_id AS c, a.turn AS s, b.turn AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn >= a.turn WHERE a.role = 'user' AND (SELECT count(DISTINCT m.turn) FROM conversations m WHERE m.conv_id = a.conv_id AND m.turn BETWEEN a.turn AND b.turn) = b.turn - a.turn + 1"),
    "zero_arity": Query("any() :- ord(_, _, _, _). go(R) :- region(R, _), any().", {"any": 0, "go": 1}, "go", ("r",), f"SELECT DISTINCT r FROM {R} WHERE EXISTS (SELECT 1 FROM orders)"),
    "mixed_kinds": Query("val(K) :- region(K, _). val(K) :- region(_, K). back(R) :- val(R), region(R, _).", {"val": 1, "back": 1}, "back", ("r",), f"SELECT DISTINCT r FROM {R}"),
}
for _name, _op in (("eq", "="), ("neq", "!="), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    PROGRAMS[f"cmp_{_name}"] = Query(f"hit(P) :- part(P, _, _, Z), Z {_op} 15.", {"hit": 1}, "hit", ("p",), f"SELECT DISTINCT p FROM {P} WHERE z {_op} 15")
PROGRAMS["head_constants"] = Query('tag(N, "ASIA", 7, true) :- nation(N, _, R), region(R, "ASIA").', {"tag": 4}, "tag", ("n", "s", "i", "b"), f"SELECT DISTINCT n, 'ASIA' AS s, 7::BIGINT AS i, true AS b FROM {N} JOIN {R} USING (r) WHERE rn = 'ASIA'")


def contains_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = solve(spark, sf_dir, "buyer(C) :- ord(_, C, _, _).", {"buyer": 1})
    return result.contains_batch("buyer", spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))


def enumerate_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, total = solve(spark, sf_dir, "buyer(C) :- ord(_, C, _, _).", {"buyer": 1}).enumerate_capacity("buyer", 10)
    return spark.createDataFrame([(len(rows), total, total > 10)], "listed long, total long, truncated boolean")


def derived_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = solve(spark, sf_dir, "a(C) :- customer(C, _, _). b(N) :- nation(N, _, _).", {"a": 1, "b": 1})
    return spark.createDataFrame([(result.derived_fact_count,)], "n long")


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = """
        allow(C) :- ord(_, C, "F", _).
        reduce(C) :- ord(_, C, "P", _).
        deny(C) :- customer(C, _, "BUILDING").
    """
    result = solve(spark, sf_dir, program, {"allow": 1, "reduce": 1, "deny": 1})
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    for name in ("deny", "reduce", "allow"):
        facts = result.relation(name).select(F.col("a0").alias(f"{name}_key"), F.lit(True).alias(name))
        people = people.join(facts, people["c_custkey"] == facts[f"{name}_key"], "left")
    return people.select("c_custkey", decision_column(F.col("deny"), F.col("reduce"), F.col("allow")).alias("decision"))


def fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solves and rule texts that must fail as a whole, and two that must not."""
    run = lambda program, derived, **more: lambda: solve(spark, sf_dir, program, derived, **more).derived_fact_count
    rows = [
        status("kinds", run('p(N) :- nation(N, M, _), M > 0.', {"p": 1})),
        status("overflow", run("p(N) :- nation(N, _, _), N * 2147483647 * 2147483647 * 2147483647 > 0.", {"p": 1})),
        status("guarded", run("p(N) :- nation(N, M, _), not(nation(N, M, N)), N >= 0.", {"p": 1})),
        status("depth", run("p(Y) :- ring(0, Y). p(Z) :- p(Y), ring(Y, Z).", {"p": 1}, limits=SMALL)),
        status("shallow", run("p(Y) :- hop(0, Y). p(Z) :- p(Y), hop(Y, Z).", {"p": 1}, limits=SMALL)),
        status("capacity", run("p(A, B, C) :- region(A, _), region(B, _), region(C, _).", {"p": 3}, limits=SMALL)),
        status("unsafe", run("p(X) :- nation(Y, _, _).", {"p": 1})),
        status("cycle", run("p(X) :- nation(X, _, _), not(q(X)). q(X) :- nation(X, _, _), not(p(X)).", {"p": 1, "q": 1})),
        status("syntax", run("p(X) :- nation(X, _, _)", {"p": 1})),
    ]
    return spark.createDataFrame(rows, "name string, ok boolean, code int, category string")


def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = solve(spark, sf_dir, "up(X, Y) :- hop(X, Y). up(X, Z) :- up(X, Y), hop(Y, Z).", {"up": 2}, limits=LARGE)
    return spark.createDataFrame(list(enumerate(result.explain_document("up", 0, 15).splitlines())), "line long, text string")


def proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = solve(spark, sf_dir, "up(X, Y) :- hop(X, Y). up(X, Z) :- up(X, Y), hop(Y, Z).", {"up": 2}, limits=LARGE)
    rows = [(n.index, n.rule_id, n.fact[0], n.deny_reason, n.depth, ",".join(str(c.value) for c in n.fact[1]), -1 if n.parent is None else n.parent) for n in result.proof()]
    return spark.createDataFrame(rows, "idx long, rule_id int, predicate string, deny_reason string, depth long, fact string, parent long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Programs, what else results offer, and the interface around solving (surface_queries.py)."""
    own = (contains_batch, enumerate_capacity, derived_count, decision, fail_closed, explain_text, proof)
    return {n: _run(q) for n, q in PROGRAMS.items()} | {f.__name__: f for f in own} | surface_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in PROGRAMS.items() if q.sql} | surface_queries.oracle_sql() | {
        "contains_batch": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS contained FROM customer",
        "enumerate_capacity": "SELECT least(10, count(DISTINCT o_custkey)) AS listed, count(DISTINCT o_custkey) AS total, count(DISTINCT o_custkey) > 10 AS truncated FROM orders",
        "derived_count": "SELECT (SELECT count(DISTINCT c_custkey) FROM customer) + (SELECT count(DISTINCT n_nationkey) FROM nation) AS n",
        "decision": """
            WITH f AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS d, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS r,
                              c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS a FROM customer)
            SELECT c_custkey, CASE WHEN d AND (r OR a) THEN 'deny_conflict' WHEN d THEN 'deny' WHEN r THEN 'reduced' WHEN a THEN 'allow' ELSE 'deny_default' END AS decision FROM f""",
        "fail_closed": """
            SELECT * FROM (VALUES ('kinds', false, -2::INTEGER, 'comparison_type_error'), ('overflow', false, -2, 'comparison_type_error'), ('guarded', true, 0, 'none'),
                ('depth', false, -12, 'max_depth'), ('shallow', true, 0, 'none'), ('capacity', false, -12, 'idb_overflow'), ('unsafe', false, -2, 'PARSER_UNSAFE_VARIABLE'),
                ('cycle', false, -2, 'POLICY_NOT_STRATIFIABLE'), ('syntax', false, -2, 'PARSER_EXPECTED_DOT')) t(name, ok, code, category)""",
        "explain_text": """
            SELECT line::BIGINT AS line, text FROM (VALUES (0, 'POLICYLOG-v2'), (1, 'document=why-true'), (2, 'status=complete'), (3, 'steps=3 premises=5'),
                (4, 'step=0 rule=1 fact="up"(0,5)'), (5, 'premise=0 body=0 kind=positive origin=edb fact="hop"(0,5) parent=-'),
                (6, 'step=1 rule=2 fact="up"(0,10)'), (7, 'premise=1 body=0 kind=positive origin=idb fact="up"(0,5) parent=0'), (8, 'premise=2 body=1 kind=positive origin=edb fact="hop"(5,10) parent=-'),
                (9, 'step=2 rule=2 fact="up"(0,15)'), (10, 'premise=3 body=0 kind=positive origin=idb fact="up"(0,10) parent=1'), (11, 'premise=4 body=1 kind=positive origin=edb fact="hop"(10,15) parent=-'),
                (12, 'result-step=2')) t(line, text)""",
        "proof": """
            SELECT idx, (CASE depth WHEN 0 THEN 1 ELSE 2 END)::INTEGER AS rule_id, 'up' AS predicate, 'DENY_NONE' AS deny_reason, depth,
                n || ',' || (n + 5 * (depth + 1)) % 25 AS fact, CASE depth WHEN 0 THEN -1 ELSE idx - 25 END AS parent
            FROM (SELECT n_nationkey::BIGINT AS n, depth, depth * 25 + n_nationkey AS idx FROM nation, (SELECT unnest(range(0, 3)) AS depth) d) s WHERE idx < 64""",
    }
