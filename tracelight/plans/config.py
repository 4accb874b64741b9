"""Settings from TOML files: one that the environment names, the repository's, the
user's, or the defaults. Read on the driver; nothing of it is distributed."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from ..functions.redaction import BUILTINS, Redactor
from ..operators.retention import Policy

VARIABLE = "TRACELIGHT_CONFIG"
IN_REPOSITORY = ".tracelight.toml"
OF_USER = ".config/tracelight/config.toml"


@dataclass(frozen=True)
class Pattern:
    name: str
    pattern: str
    description: str = ""


@dataclass(frozen=True)
class Privacy:
    enabled: bool = True
    use_builtin_patterns: bool = True
    custom_patterns: tuple[Pattern, ...] = ()
    disabled_patterns: tuple[str, ...] = ()
    audit_log: bool = False

    def redactor(self) -> Redactor:
        """With a warning for each name that is no built-in pattern, beside those for
        patterns that do not compile, which are skipped."""
        made = Redactor.configured(self.enabled, self.use_builtin_patterns, self.disabled_patterns, tuple((p.name, p.pattern, p.description) for p in self.custom_patterns))
        unknown = sorted(set(self.disabled_patterns) - {p[0] for p in BUILTINS}) if self.enabled else []
        return Redactor(made.patterns, made.unicode, (*(f"{n} is no built-in pattern" for n in unknown), *made.warnings))


@dataclass(frozen=True)
class Retention:
    max_age_days: int | None = None
    auto_purge: bool = False
    retain_refs: tuple[str, ...] = ("refs/heads/main",)
    min_commits: int | None = 100

    def policy(self) -> Policy:
        return Policy(self.max_age_days, self.retain_refs, self.min_commits or 0)


@dataclass(frozen=True)
class Analysis:
    max_pending_age_hours: int = 24
    similarity_threshold: float = 0.6


@dataclass(frozen=True)
class Config:
    privacy: Privacy = field(default_factory=Privacy)
    retention: Retention | None = None
    analysis: Analysis = field(default_factory=Analysis)


def _made(kind, values: dict, where: str):
    """A section: keys it does not know are ignored, missing ones have their defaults, and
    a value of another type is refused."""
    out = {}
    for f in fields(kind):
        if f.name not in values:
            continue
        v, want = values[f.name], str(f.type)
        if want.startswith("tuple"):
            good = isinstance(v, list)
            v = tuple(_made(Pattern, x, f"{where}.{f.name}") if "Pattern" in want else x for x in v) if good else v
            good = good and ("Pattern" in want or all(isinstance(x, str) for x in v))
        elif want == "bool":
            good = isinstance(v, bool)
        elif want.startswith("int"):
            good = isinstance(v, int) and not isinstance(v, bool) and v >= 0
        elif want == "float":
            good, v = isinstance(v, (int, float)) and not isinstance(v, bool), v
        else:
            good = isinstance(v, str)
        if not good:
            raise ValueError(f"{where}.{f.name}: {v!r} is not of type {want}")
        out[f.name] = v
    try:
        return kind(**out)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from None


def read(path: str | Path) -> Config:
    """A file's settings; one that is missing or is not TOML is an error that names it."""
    try:
        found = tomllib.loads(Path(path).read_text())
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ValueError(f"{path}: {e}") from e
    parts = {k: found.get(k) for k in ("privacy", "retention", "analysis")}
    return Config(_made(Privacy, parts["privacy"] or {}, "privacy"), None if parts["retention"] is None else _made(Retention, parts["retention"], "retention"), _made(Analysis, parts["analysis"] or {}, "analysis"))


def discover(root: str | Path, environ=None, home: str | Path | None = None) -> Config:
    """The first of: the file that the environment names, which must exist; the
    repository's; the user's; the defaults."""
    environ = os.environ if environ is None else environ
    if environ.get(VARIABLE):
        try:
            return read(environ[VARIABLE])
        except ValueError as e:
            raise ValueError(f"{VARIABLE}: {e}") from e
    for path in (Path(root) / IN_REPOSITORY, Path(home or Path.home()) / OF_USER):
        if path.exists():
            return read(path)
    return Config()
