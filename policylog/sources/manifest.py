"""Policy sets from a JSON manifest and rule texts, from memory or from files. Facts are never read from files here."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import TYPE_CHECKING

from policylog.errors import Code, DatalogError, refuse
from policylog.registry import Kind

if TYPE_CHECKING:
    from policylog.engine import Engine, Ruleset

# The manifest's fields and their types, and the modes of a policy.
ROOT = {"policy_set_id": str, "policy_set_version": str, "manifest_version": str, "default_profile": str, "created_for": str, "policies": list, "capabilities": list, "strict_loading": bool, "fail_closed": bool}
POLICY = {"policy_id": str, "domain": str, "file": str, "sha256": str, "mode": str, "description": str, "enabled": bool}
OPTIONAL = {"idb_predicates", "queries"}
MODES = ("enforce", "shadow", "test_only")


@dataclass
class PolicySet:
    policy_set_id: str
    version: str
    rulesets: list[Ruleset] = field(default_factory=list)
    queries: set[tuple[str, int]] = field(default_factory=set)


def _bad(diagnostic: str, message: str, code: Code = Code.INVALID_FIELD, **where) -> DatalogError:
    return refuse(code, diagnostic, "manifest", message, **where)


def _fields(entry: object, known: dict, optional: set[str], what: str) -> dict:
    if not isinstance(entry, dict):
        raise _bad("MANIFEST_INVALID_FIELD", f"{what} isn't a JSON object", field=what)
    if extra := [k for k in entry if k not in known and k not in optional]:
        raise _bad("MANIFEST_UNKNOWN_FIELD", f"{what} has a field that manifests don't have", field=extra[0])
    for name, of in known.items():
        if not isinstance(entry.get(name), of):
            raise _bad("MANIFEST_INVALID_FIELD", f"{what} lacks a field, or it has another type", field=name)
    return entry


def load_manifest(engine: Engine, text: str | bytes, bundle: Mapping[str, str | bytes], profile: str | None = None, allow_test_only: bool = False) -> PolicySet:
    """bundle: rule texts by the file names that the manifest gives. Every text must have its stated SHA-256. A policy that
    is not enabled is skipped; idb_predicates is accepted and ignored; queries becomes the ruleset's whitelist."""
    try:
        root = json.loads(text)
    except (ValueError, UnicodeError) as e:
        raise _bad("MANIFEST_INVALID_JSON", "the manifest can't be read as JSON") from e
    root = _fields(root, ROOT, set(), "manifest")
    profile = engine.profile if profile is None else profile
    if root["default_profile"] != profile:
        raise _bad("MANIFEST_INVALID_FIELD", f"default_profile must be {profile!r}", field="default_profile", token=root["default_profile"])
    out = PolicySet(root["policy_set_id"], root["policy_set_version"])
    for entry in root["policies"]:
        entry = _fields(entry, POLICY, OPTIONAL, "policy")
        if entry["enabled"]:
            if len(out.rulesets) >= engine.limits.policies:
                raise DatalogError(Code.PAYLOAD_TOO_LARGE, "the manifest enables more policies than an engine may hold")
            out.rulesets.append(_policy(engine, entry, bundle, allow_test_only, out))
    return out


def _policy(engine: Engine, entry: dict, bundle: Mapping[str, str | bytes], allow_test_only: bool, out: PolicySet) -> Ruleset:
    if entry["domain"] not in engine.domains.known:
        raise _bad("MANIFEST_UNKNOWN_DOMAIN", "no domain of this name is registered", Code.UNSUPPORTED, domain=entry["domain"])
    if entry["mode"] == "test_only" and not allow_test_only:
        raise _bad("MANIFEST_TEST_ONLY_REJECTED", "this caller doesn't load policies for tests", Code.FORBIDDEN)
    if entry["mode"] not in MODES:
        raise _bad("MANIFEST_INVALID_FIELD", f"a policy's mode is one of {', '.join(MODES)}", field="mode")
    if not re.fullmatch("[0-9a-f]{64}", entry["sha256"]):
        raise _bad("MANIFEST_INVALID_FIELD", "a SHA-256 is 64 digits of 0-9 and a-f", field="sha256")
    if entry["file"] not in bundle:
        raise _bad("MANIFEST_POLICY_NOT_FOUND", "there is no rule text of this name", Code.NOT_FOUND, file=entry["file"])
    source = bundle[entry["file"]]
    data = source.encode() if isinstance(source, str) else source
    if hashlib.sha256(data).hexdigest() != entry["sha256"]:
        raise _bad("MANIFEST_SHA_MISMATCH", "policy text has another SHA-256", file=entry["file"])
    ruleset = engine.load_inline_ruleset(entry["domain"], entry["policy_id"], data, mode=entry["mode"], file=entry["file"])
    allowed = set()
    for q in entry.get("queries") or []:
        name, arity = (q.get("name"), q.get("arity")) if isinstance(q, dict) else (None, None)
        known = ruleset.registry.predicates.get(name)
        if known is None or known.arity != arity or not known.kinds & Kind.QUERY:
            raise _bad("REGISTRY_CONFLICT", "queries must name QUERY predicates of the domain", predicate=str(name))
        allowed.add((name, arity))
    if len(allowed) > engine.limits.query_whitelist:
        raise DatalogError(Code.PAYLOAD_TOO_LARGE, "the manifest allows more queries than a ruleset may list")
    ruleset.whitelist = allowed
    out.queries |= allowed
    return ruleset


def safe_path(base: Path, name: str) -> Path:
    """Only relative paths without .. or backslashes."""
    if not name or name.startswith("/") or "\\" in name or ".." in name.split("/"):
        raise _bad("MANIFEST_INVALID_FIELD", "rule texts must lie in the manifest's folder", Code.FORBIDDEN, file=name)
    return base / name


def load_manifest_file(engine: Engine, path: str | Path, allow_test_only: bool = False) -> PolicySet:
    """A manifest whose profile is ``enforce``, with rule texts beside it."""
    path = Path(path)
    try:
        text = path.read_bytes()
    except OSError as e:
        raise DatalogError(Code.IO, f"can't read {path}") from e

    class Files(dict):
        def __contains__(self, name: object) -> bool:
            return safe_path(path.parent, str(name)).is_file()

        def __getitem__(self, name: str) -> bytes:
            return safe_path(path.parent, name).read_bytes()

    return load_manifest(engine, text, Files(), "enforce", allow_test_only)
