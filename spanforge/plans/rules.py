"""Rulesets: files of declarative rules, read and compiled on the driver into plain values for Column expressions.

Lookup order for a ruleset NAME in a folder: _ruleset_NAME.{yaml,yml,json}, then _ruleset.{yaml,yml,json}. Rule files are
merged in the order in which the ruleset names them, later ones over earlier ones; macros are replaced within macros too.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

import yaml

RULES = Path(__file__).resolve().parent.parent / "rules"
SUFFIXES = (".yaml", ".yml", ".json")


def read_document(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON mapping; an empty file is an empty mapping."""
    path = Path(path)
    text = path.read_text("utf-8-sig")
    found = json.loads(text) if path.suffix == ".json" else yaml.safe_load(text)
    if found is not None and not isinstance(found, dict):
        raise ValueError(f"{path}: a mapping is needed")
    return found or {}


def find_ruleset(folder: str | Path, name: str = "default") -> Path:
    for stem in (f"_ruleset_{name}", "_ruleset"):
        for suffix in SUFFIXES:
            if (path := Path(folder) / f"{stem}{suffix}").is_file():
                return path
    raise FileNotFoundError(f"no ruleset {name!r} in {folder}")


def expand(value: Any, macros: dict[str, str]) -> Any:
    """`value` with every {NAME} of `macros` replaced, in nested lists and mappings and in what a macro brings in."""
    if isinstance(value, str):
        for _ in range(len(macros) + 1):
            before = value
            for name, text in macros.items():
                value = value.replace("{" + name + "}", text)
            if value == before:
                break
        return value
    if isinstance(value, list):
        return [expand(x, macros) for x in value]
    if isinstance(value, dict):
        return {k: expand(x, macros) for k, x in value.items()}
    return value


def merge(under: dict, over: dict) -> dict:
    """Mappings one over the other; lists and scalars of `over` replace those of `under`."""
    out = dict(under)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def fingerprint(paths: list[Path]) -> str:
    """Sixteen hex digits over names and bytes of the files, in order of their paths."""
    digest = hashlib.sha256()
    for path in sorted(paths):
        digest.update(path.name.encode() + b"\n" + path.read_bytes() + b"\n\n")
    return digest.hexdigest()[:16]


def updated_at(mtimes: list[float]) -> str:
    return datetime.fromtimestamp(max(mtimes, default=0), timezone.utc).isoformat()


@dataclass(frozen=True)
class TypeRule:
    """One entity type, compiled: `pattern` is a Java regex with Unicode classes over all of its alternatives; `longest` has
    them one by one where the longest has to win."""

    key: str
    pattern: str
    max_len: int
    min_len: int = 0
    needs: str | None = None
    longest: tuple[str, ...] = ()
    trim: bool = False
    checksum: bool = False
    postfilter: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)


def alternation(patterns: list[str]) -> str:
    return "(?U)" + (patterns[0] if len(patterns) == 1 else "(?:" + "|".join(patterns) + ")")


def compile_type(key: str, doc: dict, default_len: int = 240) -> TypeRule:
    return TypeRule(
        key, alternation(doc["patterns"]), int(doc.get("max_match_len", default_len)), int(doc.get("min_match_len", 0)), doc.get("needs"),
        tuple(f"(?U){p}" for p in doc["patterns"]) if doc.get("longest") else (), bool(doc.get("trim", False)), bool(doc.get("checksum", False)), doc.get("postfilter") or {}, {k: v for k, v in doc.items() if k.startswith("bank_")},
    )


def bad_patterns(types: dict[str, TypeRule]) -> list[tuple[str, str, str]]:
    """(type, pattern, what is wrong) of every pattern that the JVM's regex engine doesn't compile; needs a running session."""
    from py4j.protocol import Py4JJavaError
    from pyspark.sql import SparkSession

    compile_ = SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile
    found = []
    for key, rule in types.items():
        for pattern in [*rule.longest, rule.pattern, *([rule.needs] if rule.needs else [])]:
            try:
                compile_(pattern)
            except Py4JJavaError as e:
                found.append((key, pattern, e.java_exception.getDescription()))
    return found


def checked(bundle: Bundle) -> Bundle:
    """`bundle`, if all of its patterns compile: else an error that names them, before any task runs."""
    if bad := bad_patterns(bundle.types):
        raise ValueError("; ".join(f"{key}: {what} in {pattern!r}" for key, pattern, what in bad))
    return bundle


class Reloading:
    """A ruleset that is read again when one of its files has changed or gone; `get` returns the current bundle."""

    def __init__(self, name: str = "default", folder: str | Path | None = None):
        self.name, self.folder = name, folder or RULES
        self.bundle = load(name, self.folder)

    def get(self) -> Bundle:
        if stale(self.bundle):
            self.bundle = load(self.name, self.folder)
        return self.bundle


@dataclass(frozen=True)
class Bundle:
    """A ruleset as loaded: steps in order, compiled types, the context section, and what tells its version."""

    name: str
    steps: list[str]
    types: dict[str, TypeRule]
    context: dict
    limit: int
    version: str
    updated_at: str
    mtimes: dict[str, float]


def load(name: str = "default", folder: str | Path = RULES, macros: dict[str, str] | None = None) -> Bundle:
    """Reads a ruleset. `macros` go over those of the rule files."""
    top = find_ruleset(folder, name)
    head = read_document(top)
    paths = [top, *(Path(folder) / file for file in (head.get("rule_files") or {}).values())]
    merged: dict = {}
    for path in paths[1:]:
        merged = merge(merged, read_document(path))
    merged = expand(merged, {**(merged.get("macros") or {}), **(head.get("macros") or {}), **(macros or {})})
    defaults = head.get("defaults") or {}
    types = {k: compile_type(k, v, int(defaults.get("max_match_len_default", 240))) for k, v in (merged.get("types") or {}).items() if v.get("enabled", True)}
    mtimes = {str(p): p.stat().st_mtime for p in paths}
    return Bundle(head.get("ruleset_name", name), list(head.get("steps") or []), types, context_section(merged), int(defaults.get("max_results_per_type", 500)), fingerprint(paths), updated_at(list(mtimes.values())), mtimes)


def context_section(doc: dict) -> dict:
    """The context mapping with top-level sections named context_TYPE merged into per_type."""
    section = dict(doc.get("context") or {})
    per_type = dict(section.get("per_type") or {})
    for k, v in doc.items():
        if k.startswith("context_") and isinstance(v, dict):
            per_type[k.removeprefix("context_")] = merge(per_type.get(k.removeprefix("context_"), {}), v)
    return section | {"per_type": per_type}


def stale(bundle: Bundle) -> bool:
    """Whether a file of the bundle is gone or has changed since it was read."""
    return any(not Path(p).is_file() or Path(p).stat().st_mtime != t for p, t in bundle.mtimes.items())


def list_rulesets(folder: str | Path = RULES) -> list[Bundle]:
    """All rulesets of a folder, by name."""
    found = {}
    for path in sorted(Path(folder).glob("_ruleset*")):
        if path.suffix in SUFFIXES:
            name = path.stem.removeprefix("_ruleset").removeprefix("_") or "default"
            found.setdefault(name, load(name, folder))
    return [found[k] for k in sorted(found)]


def bank_patterns(path: str | Path) -> list[tuple[str, list[str]]]:
    """(institution, patterns) of a JSON dictionary {code: {institution, patterns}}; entries without patterns are left out."""
    return [(v["institution"], v["patterns"]) for v in read_document(path).values() if v.get("institution") and v.get("patterns")]
