"""Settings with typed defaults: a TOML file's, then the environment's, which come first."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields

from . import schema

PREFIX = "TARNLOOM_"


@dataclass(frozen=True)
class Config:
    max_value_bytes: int = schema.MAX_VALUE_BYTES
    max_batch: int = schema.MAX_BATCH
    max_pending: int = schema.MAX_PENDING
    publish_seconds: int = schema.PUBLISH_SECONDS
    leaf_limit: int = schema.LEAF_LIMIT
    bands: int = 8
    hash_algorithm: str = "sha256"
    auto_sync: bool = True


def _typed(kind: str, name: str, value: object) -> object:
    if kind == "bool":
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            return str(value).lower() in ("1", "true", "yes", "on")
    elif kind == "int" and not isinstance(value, bool) and str(value).strip().lstrip("-").isdigit():
        return int(str(value))
    elif kind == "str" and isinstance(value, str):
        return value
    raise ValueError(f"{name}: {value!r} is no {kind}")


def load(path: str | None = None, environment: Mapping[str, str] = os.environ) -> Config:
    """path: a TOML file; names it has that Config hasn't are errors, so that a slip is seen."""
    found: dict[str, object] = {}
    if path is not None:
        with open(path, "rb") as f:
            found = tomllib.load(f)
    kinds = {f.name: str(f.type) for f in fields(Config)}
    if unknown := found.keys() - kinds.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    found |= {n: environment[PREFIX + n.upper()] for n in kinds if PREFIX + n.upper() in environment}
    return Config(**{n: _typed(kinds[n], n, v) for n, v in found.items()})
