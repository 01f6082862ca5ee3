"""A deterministic Datalog engine for policies on Spark: rules are compiled to DataFrame plans."""

from policylog.engine import Engine, Ruleset, SolveResult, build_limits
from policylog.errors import Code, DatalogError, Diagnostic, DomainAlreadyRegisteredError, DomainRegistryFullError
from policylog.functions.decision import Decision, decide, decision_column
from policylog.limits import LARGE, SMALL, UNBOUNDED, Limits
from policylog.registry import Kind, Predicate, Registry
from policylog.sources.manifest import load_manifest, load_manifest_file

__all__ = ["LARGE", "SMALL", "UNBOUNDED", "Code", "DatalogError", "Decision", "Diagnostic", "DomainAlreadyRegisteredError", "DomainRegistryFullError", "Engine", "Kind", "Limits", "Predicate", "Registry", "Ruleset", "SolveResult", "build_limits", "decide", "decision_column", "load_manifest", "load_manifest_file"]
