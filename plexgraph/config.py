"""Settings: defaults, a YAML file found upwards from a folder, and environment variables over both."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from plexgraph.sources.discover import EXCLUDED, MAX_FILE_SIZE

FILE_NAME = ".plexgraph.yml"
PREFIX = "PLEXGRAPH_"


@dataclass
class Parsing:
    exclude_patterns: list[str] = field(default_factory=lambda: list(EXCLUDED))
    max_file_size: int = MAX_FILE_SIZE


@dataclass
class Storage:
    path: str = ".plexgraph/store"
    keep_versions: int = 2


@dataclass
class Export:
    max_nodes: int = 1000
    max_edges: int = 5000


@dataclass
class Settings:
    project_root: str = "."
    log_level: str = "WARN"
    parsing: Parsing = field(default_factory=Parsing)
    storage: Storage = field(default_factory=Storage)
    export: Export = field(default_factory=Export)


_SECTIONS = {"parsing": Parsing, "storage": Storage, "export": Export}


def find(start: str = ".") -> Path | None:
    """The settings file of a folder or of the nearest one above it."""
    here = Path(start).resolve()
    return next((p / FILE_NAME for p in (here, *here.parents) if (p / FILE_NAME).is_file()), None)


def _filled(kind, given: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(given) - known:
        raise ValueError(f"{where}: no setting named {', '.join(sorted(map(str, unknown)))}")
    return kind(**given)


def load(path: str | Path | None = None, start: str = ".", environment: dict[str, str] | None = None) -> Settings:
    """Settings from a file, or from the one found upwards, or defaults. Relative paths count from the file's folder (or
    from start). PLEXGRAPH_PROJECT_ROOT, PLEXGRAPH_STORAGE_PATH, PLEXGRAPH_PARSING_MAX_FILE_SIZE and so on, one for each
    setting, win over the file; lists are divided by commas."""
    found = Path(path) if path else find(start)
    data: dict = {}
    if found:
        if not found.is_file():
            raise FileNotFoundError(f"no settings file {found}")
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading a settings file needs PyYAML") from e
        data = yaml.safe_load(found.read_text(encoding="utf-8")) or {}
        if not isinstance(data, dict):
            raise ValueError(f"{found}: not a table of settings")
    given = {k: _filled(_SECTIONS[k], v or {}, f"{found}, {k}") if k in _SECTIONS else v for k, v in data.items()}
    out = _filled(Settings, given, str(found))
    environment = os.environ if environment is None else environment
    for holder, name in ((out, ""), *((getattr(out, k), f"{k}_") for k in _SECTIONS)):
        for f in fields(holder):
            text = environment.get(f"{PREFIX}{name}{f.name}".upper())
            if text is not None and f.name not in _SECTIONS:
                old = getattr(holder, f.name)
                setattr(holder, f.name, int(text) if isinstance(old, int) else [x for x in text.split(",") if x] if isinstance(old, list) else text)
    base = found.resolve().parent if found else Path(start).resolve()
    out.project_root = str((base / out.project_root).resolve())
    if "://" not in out.storage.path:
        out.storage.path = str(Path(out.project_root, out.storage.path))
    return out


def save(settings: Settings, path: str | Path) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(asdict(settings), sort_keys=False), encoding="utf-8")
