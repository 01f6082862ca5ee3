"""Capacity presets. Whatever exceeds a limit fails as a whole; nothing is ever cut off silently."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """None means unlimited. Fact and depth limits hold for solving, the others for rule text and registries."""

    name: str
    edb_facts: int | None = None
    idb_facts: int | None = None
    facts_per_predicate: int | None = None
    fixpoint_depth: int | None = None
    safety_rounds: int = 100_000
    string_bytes: int = 1024
    integer: int = 2_147_483_647
    predicates: int = 128
    atoms: int = 256
    arity: int = 4
    predicate_name_bytes: int = 63
    rules: int = 128
    rule_facts: int = 128
    body_literals: int = 8
    strata: int = 4
    named_variables: int = 26
    variables: int = 32
    expression_nodes: int = 32
    expression_depth: int = 8
    proof_nodes: int = 64
    proof_depth: int = 10
    query_whitelist: int = 64
    domains: int = 16
    policies: int = 8

    def as_dict(self) -> dict[str, int | None]:
        return {k: v for k, v in self.__dict__.items() if k != "name"}


SMALL = Limits("SMALL", edb_facts=1024, idb_facts=1024, facts_per_predicate=64, fixpoint_depth=10)
LARGE = Limits("LARGE", edb_facts=2048, idb_facts=2048, facts_per_predicate=256, fixpoint_depth=10)
#: For DataFrames of any size: no fact or depth caps, and the schema's 4-column limit lifted is still kept for rule text.
UNBOUNDED = Limits("UNBOUNDED")
PRESETS = {x.name: x for x in (SMALL, LARGE, UNBOUNDED)}
