"""Settings: defaults, merged with a file's and with overrides, checked."""

from __future__ import annotations

import json
from collections.abc import Mapping
from copy import deepcopy
from pathlib import Path
from typing import Any

from symgraph.sources.files import IGNORED

DEFAULTS: dict[str, Any] = {
    "project": {"name": "", "root": "."},
    "languages": ["php", "javascript", "typescript", "python", "css", "scss", "go", "rust"],
    "ignore": list(IGNORED),
    "search": {"limit": 20, "alpha": 0.5},
    "context": {"budget": 4000},
    "watch": {"gap_seconds": 2.0},
}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with what ``over`` sets: mappings are merged, anything else replaces, null leaves the default."""
    out = deepcopy(dict(base))
    for k, v in over.items():
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = deepcopy(v)
    return out


def problems(config: Mapping[str, Any]) -> list[str]:
    """What is wrong with a configuration, in words; nothing if it can be used."""
    out = [f"unknown setting: {k}" for k in config if k not in DEFAULTS]
    for k, default in DEFAULTS.items():
        if k in config and not isinstance(config[k], type(default)):
            out.append(f"{k} must be a {type(default).__name__}")
    if not out:
        out += [f"unknown language: {x}" for x in config["languages"] if x not in DEFAULTS["languages"]]
        if not 0 <= config["search"].get("alpha", 0.5) <= 1:
            out.append("search.alpha must lie between 0 and 1")
        if config["context"].get("budget", 1) <= 0 or config["watch"].get("gap_seconds", 1) <= 0:
            out.append("budgets and gaps must be positive")
    return out


def load(path: str | None = None, **overrides: Any) -> dict[str, Any]:
    """The settings of a YAML or JSON file (none: the defaults) with overrides; a faulty one is an error that names every fault."""
    found: Mapping[str, Any] = {}
    if path and Path(path).exists():
        text = Path(path).read_text()
        if path.endswith(".json"):
            found = json.loads(text or "{}")
        else:
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML settings need the yaml package; JSON ones do not") from e
            found = yaml.safe_load(text) or {}
        if not isinstance(found, Mapping):
            raise ValueError("settings must be a mapping")
    config = merged(merged(DEFAULTS, found), overrides)
    if faults := problems(config):
        raise ValueError("; ".join(faults))
    return config
