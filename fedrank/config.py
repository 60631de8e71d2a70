"""Settings from the environment, with defaults; what is out of bounds or no number is the default."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, fields

PREFIX = "FEDRANK_"
TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def read_int(name: str, default: int, least: int | None = None, most: int | None = None, env=None) -> int:
    """The number that the value begins with."""
    found = re.match(r"\s*([+-]?\d+)", (os.environ if env is None else env).get(name, ""))
    value = int(found[1]) if found else default
    return default if (least is not None and value < least) or (most is not None and value > most) else value


def read_bool(name: str, default: bool, env=None) -> bool:
    value = (os.environ if env is None else env).get(name, "").strip().lower()
    return True if value in TRUE else False if value in FALSE else default


def read_text(name: str, default: str, env=None) -> str:
    return (os.environ if env is None else env).get(name, "").strip() or default


@dataclass(frozen=True)
class Config:
    host: str = "127.0.0.1"
    port: int = 3847
    cache_ttl_ms: int = 600_000
    cache_max: int = 256
    max_navigations: int = 2
    prewarm: bool = False
    fast_path_ms: int = 2000
    max_fast_path_ms: int = 4500
    poll_ms: int = 100
    min_engines: int = 4
    search_timeout_ms: int = 10_000
    api_timeout_ms: int = 8_000
    extract_timeout_ms: int = 15_000
    max_content_chars: int = 50_000
    enable_brave: bool = False
    brave_mode: str = "auto"
    brave_api_key: str = ""
    brave_country: str = "us"
    brave_lang: str = "en"
    health_tool: bool = True

    @classmethod
    def load(cls, env=None) -> Config:
        got = {}
        for f in fields(cls):
            name = PREFIX + f.name.upper()
            if isinstance(f.default, bool):
                got[f.name] = read_bool(name, f.default, env)
            elif isinstance(f.default, int):
                got[f.name] = read_int(name, f.default, *BOUNDS.get(f.name, (None, None)), env)
            else:
                got[f.name] = read_text(name, f.default, env)
        return cls(**got)

    def public(self) -> dict:
        """All settings but secrets."""
        return {k: ("***" if v else "") if k == "brave_api_key" else v for k, v in asdict(self).items()}


BOUNDS = {
    "port": (1, 65535), "cache_ttl_ms": (1000, None), "cache_max": (1, None), "max_navigations": (1, None), "fast_path_ms": (100, None), "max_fast_path_ms": (500, None), "poll_ms": (25, None),
    "min_engines": (1, 7), "search_timeout_ms": (1000, None), "api_timeout_ms": (1000, None), "extract_timeout_ms": (1000, None), "max_content_chars": (1000, None),
}
