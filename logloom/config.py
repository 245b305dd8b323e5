"""Settings of the templater and of the host limits."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

GROUPERS = ("drain", "drain-stock", "drain-delimited", "drain-fullsearch", "statistical")
ALIASES = {"stock": "drain-stock", "delimited": "drain-delimited", "fullsearch": "drain-fullsearch"}
PARAM = "<*>"


def grouper_name(name: str, strict: bool = True) -> str:
    """Canonical grouper. Strict (command line): exact names and aliases, anything else is an error.
    Otherwise (host): any case, anything else is the default."""
    wanted = name if strict else name.lower()
    wanted = ALIASES.get(wanted, wanted)
    if wanted in GROUPERS:
        return wanted
    if strict:
        raise ValueError(f"unknown grouper: {name}")
    return GROUPERS[0]


@dataclass(frozen=True)
class TemplaterConfig:
    """``finer_keys`` also splits token counts by first token where that changes no result, which takes a look
    at all lines first; None does so where windows are fewer than the tasks that run at once."""

    grouper: str = "drain"
    depth: int = 4
    sim_th: float = 0.4
    max_children: int = 100
    template_clip: int = 120
    min_static_chars: int = 3
    sample_cap: int = 3
    slot_sample_cap: int = 6
    finer_keys: bool | None = None

    def __post_init__(self) -> None:
        if self.depth < 3:
            raise ValueError("depth must be 3 or more")
        grouper_name(self.grouper)


@dataclass(frozen=True)
class Limits:
    """Host limits; environment variables LOGLOOM_<NAME> override, bad or non-positive ones don't."""

    body_bytes: int = 4 << 20
    lines: int = 5_000
    line_chars: int = 20_000
    samples: int = 10
    inflight: int = 1_000
    timeout_s: int = 10
    ttl_s: int = 30 * 60
    sweep_s: int = 60

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Limits:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"LOGLOOM_{f.name.upper()}", "")
            if raw.isascii() and raw.isdigit() and int(raw) > 0:
                found[f.name] = int(raw)
        return cls(**found)
