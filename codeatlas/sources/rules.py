"""Framework definitions from TOML files: how a framework is detected, and its rules for kinds and features.

A file has ``name``, ``priority``, ``languages``, a table ``detect`` (``deps``, ``config_files``, ``files``,
``dir_with_files`` with ``dir`` and ``pattern``), lists ``classify`` (``id``, ``action``, ``match``) and
``auto_lift`` (``id``, ``features``, ``match``, ``strip_prefix``, ``prefix_verb``), and texts in
``prompt_hints``.  Without languages it is for all, without ``detect`` it is active wherever its
languages are.  The rules themselves are the caller's: a folder of such files."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.lifting import check_rules

#: Names of the parts of a match in files, and in rules (fixed values).
PARTS = {"file_path_contains": "path_contains", "name_min_length": "min_length", "name_starts_uppercase": "starts_uppercase", "file_name_stem": "file_stem"}
SCHEMA = 1


@dataclass(frozen=True)
class Framework:
    name: str
    priority: int
    languages: list[str]
    detect: dict
    classify: list[dict] = field(default_factory=list)
    auto_lift: list[dict] = field(default_factory=list)
    hints: dict = field(default_factory=dict)


def _match(parts: dict) -> dict:
    return {PARTS.get(k, k): v for k, v in parts.items()}


def _action(action) -> dict:
    """``"skip"``, ``{reclassify = kind}`` or ``{tag = text}``."""
    if isinstance(action, str):
        return {"action": action}
    (name, value), *more = action.items()
    if more:
        raise ValueError(f"one action at a time: {sorted(action)}")
    return {"action": name, "kind" if name == "reclassify" else name: value}


def parse_framework(text: str) -> Framework:
    """A definition from TOML; other schema versions, unknown actions, bad patterns and templates are errors."""
    raw = tomllib.loads(text)
    if raw.get("schema_version", SCHEMA) != SCHEMA:
        raise ValueError(f"schema version {raw['schema_version']} of {raw.get('name')}")
    if not raw.get("name"):
        raise ValueError("a definition needs a name")
    priority = raw.get("priority", 100)
    detect = raw.get("detect", {})
    found = {"deps": detect.get("deps", []), "configs": detect.get("config_files", []), "globs": detect.get("files", []), "dirs": [(d["dir"], d["pattern"]) for d in detect.get("dir_with_files", [])]}
    kinds = [{"id": r["id"], "priority": priority, "match": _match(r["match"])} | _action(r["action"]) for r in raw.get("classify", [])]
    lifts = [{"id": r["id"], "priority": priority, "match": _match(r["match"]), "features": r["features"], "strip_prefix": r.get("strip_prefix", []), "prefix_verb": r.get("prefix_verb", {})} for r in raw.get("auto_lift", [])]
    if any(not r["features"] for r in lifts):
        raise ValueError("a rule for features needs one feature at least")
    check_rules(kinds)
    check_rules([r | {"action": "features"} for r in lifts])
    return Framework(raw["name"], priority, raw.get("languages", []), found, kinds, lifts, raw.get("prompt_hints", {}))


def load_frameworks(folder: str) -> list[Framework]:
    """The definitions of a folder's ``.toml`` files by (priority, name); equal names are an error."""
    found = [parse_framework(p.read_text()) for p in sorted(Path(folder).glob("*.toml"))]
    if len({f.name for f in found}) < len(found):
        raise ValueError("names of definitions must be unique")
    return sorted(found, key=lambda f: (f.priority, f.name))


def detection(frameworks: list[Framework]) -> list[dict]:
    """The rules that ``extract.detect_paradigms`` takes."""
    return [{"name": f.name, "priority": f.priority, "languages": f.languages} | f.detect for f in frameworks]


def hints(frameworks: list[Framework], task: str) -> str:
    """The hints for a task (lifting, synthesis, hierarchy, discovery) of active definitions, one after another."""
    return "\n".join(f"### {f.name}\n{f.hints[task].strip()}" for f in frameworks if f.hints.get(task, "").strip())
