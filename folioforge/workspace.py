"""Project folders: defaults, overlays, artifact listing, and the steps by name."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from pathlib import Path

DEFAULTS = {
    "retrieval": {"policy": "cache_first", "ambiguity_delta": 0.05, "open_top_n": 5, "adapters": {}},
    "agentic": {"top_n": 5, "max_cycles": 3, "fit_threshold": 0.12, "web_fetch": {"enabled": True, "max_pages_per_cycle": 3, "max_chars": 6000}},
    "discovery": {"limit": 25, "timeout_s": 8, "venues": [], "year_min": None, "year_max": None},
}


def merged(defaults: dict, own: dict) -> dict:
    """``own`` laid over ``defaults``, nested dicts key by key."""
    out = copy.deepcopy(defaults)
    for k, v in (own or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def init_project(root: str | Path, name: str) -> Path:
    """Make a project's folders and settings; what is there already stays."""
    home = Path(root) / name
    for sub in ("kb", "artifacts/discovery", "artifacts/retrieval", "artifacts/sections", "artifacts/extractions", "reports"):
        (home / sub).mkdir(parents=True, exist_ok=True)
    settings = home / "project.json"
    if not settings.exists():
        settings.write_text(json.dumps({"name": name} | DEFAULTS, indent=2))
    return home


def settings_of(home: str | Path) -> dict:
    path = Path(home) / "project.json"
    return merged(DEFAULTS, json.loads(path.read_text()) if path.exists() else {})


def list_artifacts(home: str | Path) -> list[str]:
    """All files of a project, sorted, relative to it."""
    base = Path(home)
    return sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file())


def mock_rows(theme: str) -> list[dict]:
    """Two rows for a theme, for work without any source."""
    return [{"source": "mock", "source_id": f"mock-{k}", "title": f"{theme} study {k}", "venue": "Mock Venue", "year": str(2023 + k), "doi": "", "arxiv_id": "", "url": ""} for k in (1, 2)]


class Steps:
    """Named steps; an unknown name is an error that lists the known ones."""

    def __init__(self) -> None:
        self.known: dict[str, Callable] = {}

    def add(self, name: str) -> Callable:
        def keep(f: Callable) -> Callable:
            self.known[name] = f
            return f

        return keep

    def run(self, name: str, /, **options):
        if name not in self.known:
            raise ValueError(f"unknown step {name}; known are {', '.join(sorted(self.known))}")
        return self.known[name](**options)
