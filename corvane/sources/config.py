"""Settings from TOML, command line over repository file over user file over defaults."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from corvane.operators.filters import DEFAULT_EXCLUDES, MAX_DEPTH, MAX_SIZE


@dataclass(frozen=True)
class Settings:
    max_size: int = MAX_SIZE
    max_depth: int = MAX_DEPTH
    output_format: str = "both"
    link_depth: int = 1
    traverse_links: bool = False
    hidden: bool = False
    no_ignore: bool = False
    include: list[str] = field(default_factory=list)
    only_include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))

    def __post_init__(self):
        if self.include and self.only_include:
            raise ValueError("include and only_include exclude each other")
        if self.output_format not in ("tree", "files", "both"):
            raise ValueError(f"unknown output format {self.output_format!r}")


def overlay(base: Settings, values: dict) -> Settings:
    """base with the values that are settings; exclude patterns add to base's."""
    known = {f.name for f in fields(Settings)}
    values = {k: v for k, v in values.items() if k in known and v is not None}
    if "exclude" in values:
        values["exclude"] = list(dict.fromkeys([*base.exclude, *values["exclude"]]))
    return replace(base, **values)


def load(*paths: str | Path, **options) -> Settings:
    """Files in rising order of precedence, missing ones skipped; options come last."""
    out = Settings()
    for p in map(Path, paths):
        if p.is_file():
            out = overlay(out, tomllib.loads(p.read_text()))
    return overlay(out, options)


def exclude_pattern(value: str, base: str | Path) -> str | None:
    """The pattern that an exclude stands for in a scan of base: what exists is that file, which if absolute must lie below
    base and otherwise excludes nothing; anything else is a pattern."""
    p = Path(value)
    if not p.is_absolute() or not p.exists():
        return value
    return p.relative_to(base).as_posix() if p.is_relative_to(base) else None


def as_toml(values: dict) -> str:
    """Flat settings (text, numbers, booleans, lists of text) as TOML."""
    return "".join(f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in values.items())


def save(path: str | Path, values: dict | Settings) -> None:
    """Settings, or some of them, as a file that load() reads; its folder is made if need be."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(as_toml(asdict(values) if isinstance(values, Settings) else values), encoding="utf-8")


def first_run(path: str | Path) -> Path:
    """The user's file, which is made with the defaults if there is none and it can be."""
    path = Path(path)
    if not path.exists():
        try:
            save(path, Settings())
        except OSError:
            pass  # a home that can't be written has the defaults anyway
    return path


def repository_file(start: str | Path, name: str = ".corvane") -> Path | None:
    """The nearest file of that name at or above start."""
    p = Path(start).resolve()
    return next((d / name for d in (p, *p.parents) if (d / name).is_file()), None)
