"""Settings of a run: dataclasses with defaults, from a mapping with ${VAR} substitution."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from ..functions import patterns as P
from ..operators.prune import Settings


@dataclass(frozen=True)
class Segmentation:
    k: int = 3
    window: int = 50
    least_us: int = 10_000


@dataclass(frozen=True)
class Windows:
    size: int = 300
    block_overlap: float = 0.3
    file_overlap: float = 0.1
    max_windows: int = 20
    max_lines: int = 5000


@dataclass(frozen=True)
class Judgment:
    cutoff: int = 10
    check_after: int = 5
    check_blocks: int = 6
    expansions: int = 10


@dataclass(frozen=True)
class Config:
    segmentation: Segmentation = Segmentation()
    windows: Windows = Windows()
    judgment: Judgment = Judgment()
    pruning: Settings = Settings()
    critical: tuple[str, ...] = tuple(P.CRITICAL_KEYWORDS)
    warning: tuple[str, ...] = tuple(P.WARNING_KEYWORDS)
    strip_stamp: bool = False
    extra: Mapping[str, Any] = field(default_factory=dict)


def substituted(value: Any, env: Mapping[str, str] = os.environ) -> Any:
    """Strings with ${NAME} replaced from ``env``; unknown names stay as they are."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, Mapping):
        return {k: substituted(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, env) for v in value]
    return value


def configured(given: Mapping[str, Any], base: Any = Config(), env: Mapping[str, str] = os.environ) -> Any:
    """``base`` with the given settings; what it does not know goes to ``extra`` or is an error."""
    known = {f.name for f in fields(base)}
    changes, extra = {}, {}
    for name, value in substituted(given, env).items():
        if name not in known:
            extra[name] = value
        elif is_dataclass(getattr(base, name)):
            changes[name] = configured(value, getattr(base, name), env)
        else:
            changes[name] = tuple(value) if isinstance(getattr(base, name), tuple) else value
    if extra:
        if "extra" not in known:
            raise KeyError(f"no such settings: {sorted(extra)}")
        changes["extra"] = extra
    return replace(base, **changes)


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines of a file; comments, blank lines and quotes around values are dropped. None without the file."""
    out = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not name.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    return out


def loaded(path: str, env: Mapping[str, str] | None = None) -> Config:
    """Settings from a YAML or JSON file beside which an .env file may stand; YAML needs PyYAML."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        given = json.loads(text or "{}")
    else:
        import yaml

        given = yaml.safe_load(text) or {}
    known = env_file(os.path.join(os.path.dirname(path), ".env")) | dict(os.environ if env is None else env)
    return configured(given, env=known)
