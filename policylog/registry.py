"""Predicates, their kinds, and the closed registries that rule texts are read against."""

from __future__ import annotations

import enum
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from policylog.errors import Code, DatalogError, DomainAlreadyRegisteredError, DomainRegistryFullError, refuse
from policylog.limits import SMALL, Limits


class Kind(enum.IntFlag):
    # Bits of a predicate's kinds.
    EDB = 1
    IDB = 2
    QUERY = 4
    POLICY_FACT = 8


BASES = (Kind.EDB, Kind.POLICY_FACT, Kind.IDB)


@dataclass(frozen=True)
class Predicate:
    name: str
    arity: int
    kinds: Kind

    @property
    def base(self) -> Kind:
        """The one kind that says where its facts come from."""
        return self.kinds & ~Kind.QUERY


class Registry:
    """Predicates (one arity per name) and the atoms that rule texts may use as strings; frozen before parsing."""

    def __init__(self, predicates: Iterable[Predicate] = (), atoms: Iterable[str] = (), limits: Limits = SMALL):
        self.limits, self.frozen = limits, False
        self.predicates: dict[str, Predicate] = {}
        self.atoms: dict[str, None] = {}
        for p in predicates:
            self.add(p)
        for a in atoms:
            self.add_atom(a)

    def _open(self) -> None:
        if self.frozen:
            raise refuse(Code.INVALID_STATE, "REGISTRY_MUTATION_AFTER_FREEZE", "registry", "predicate registry is frozen", "register before loading rule texts")

    def add(self, predicate: Predicate) -> None:
        self._open()
        name = predicate.name
        if not name or len(name.encode()) > self.limits.predicate_name_bytes or not 0 <= predicate.arity <= self.limits.arity:
            raise DatalogError(Code.INVALID_FIELD, f"invalid predicate {name!r}/{predicate.arity}")
        if predicate.base not in BASES:
            raise DatalogError(Code.INVALID_FIELD, f"predicate {name!r} needs exactly one of EDB, IDB and POLICY_FACT", "add QUERY to make it queryable")
        if name in self.predicates:
            raise refuse(Code.INVALID_FIELD, "REGISTRY_CONFLICT", "registry", f"predicate {name!r} is registered twice", "one declaration and one arity per name", predicate=name)
        if len(self.predicates) >= self.limits.predicates:
            raise DatalogError(Code.PAYLOAD_TOO_LARGE, "too many predicates")
        self.predicates[name] = predicate

    def add_atom(self, atom: str) -> None:
        self._open()
        if len(atom.encode()) > self.limits.string_bytes:
            raise DatalogError(Code.PAYLOAD_TOO_LARGE, "atom too long")
        if atom not in self.atoms and len(self.atoms) >= self.limits.atoms:
            raise DatalogError(Code.PAYLOAD_TOO_LARGE, "too many atoms")
        self.atoms[atom] = None

    def freeze(self) -> Registry:
        self.frozen = True
        return self

    def find(self, name: str) -> Predicate:
        if name not in self.predicates:
            raise DatalogError(Code.INVALID_FIELD, f"unknown predicate {name!r}")
        return self.predicates[name]


#: A domain is a table of predicates, with no atoms of its own, or a function that fills a registry.
Domain = tuple[Predicate, ...] | Callable[[Registry], None]


class Domains:
    """Named domains of one engine. Registering the same table again changes nothing; another one is refused."""

    def __init__(self, limits: Limits = SMALL):
        self.limits = limits
        self.known: dict[str, Domain] = {}

    def register(self, name: str, domain: Iterable[Predicate] | Callable[[Registry], None]) -> None:
        domain = domain if callable(domain) else tuple(domain)
        if name in self.known:
            if self.known[name] != domain:
                raise DomainAlreadyRegisteredError(Code.INVALID_STATE, f"domain {name!r} is registered with another table", "choose another name")
            return
        if not name:
            raise DatalogError(Code.INVALID_ARGUMENT, "a domain needs a name")
        if len(self.known) >= self.limits.domains:
            raise DomainRegistryFullError(Code.PAYLOAD_TOO_LARGE, "too many domains")
        self.build(domain)
        self.known[name] = domain

    def build(self, domain: Domain) -> Registry:
        if callable(domain):
            registry = Registry(limits=self.limits)
            domain(registry)
            return registry
        return Registry(domain, limits=self.limits)

    def registry(self, name: str) -> Registry:
        if name not in self.known:
            raise refuse(Code.NOT_FOUND, "MANIFEST_UNKNOWN_DOMAIN", "manifest", f"unknown domain {name!r}", "register the domain first", domain=name)
        return self.build(self.known[name])
