"""Configuration: nested options with ${NAME} and ${NAME:default} from the environment, by dotted path."""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Mapping
from typing import Any

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]*))?\}")
REQUIRED = ("ocr", "extraction", "export")


def expanded(value: Any, environment: Mapping[str, str] | None = None) -> Any:
    """value with variables replaced in all its strings; one that is not set and has no default stays as it is."""
    env = os.environ if environment is None else environment
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: env.get(m[1], m[2] if m[2] is not None else m[0]), value)
    return value


class Config:
    def __init__(self, options: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None):
        self.options = expanded(copy.deepcopy(dict(options or {})), environment)

    @classmethod
    def load(cls, path: str, environment: Mapping[str, str] | None = None) -> Config:
        """From JSON, or YAML where a reader for it is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls(json.loads(text), environment)
        import yaml

        return cls(yaml.safe_load(text), environment)

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.options
        for part in path.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, path: str, value: Any) -> None:
        *parents, last = path.split(".")
        at = self.options
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def missing(self) -> list[str]:
        """Required sections that are not there."""
        return [x for x in REQUIRED if not self.get(x)]

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.options, f, indent=2, ensure_ascii=False)
