"""The check catalog: one entry per named check."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class CheckSpec:
    name: str
    category: str
    severity: str
    fn: Callable[..., Any]
    description: str
    required: tuple[str, ...]
    defaults: dict[str, Any] = field(hash=False)

    @property
    def key(self) -> str:
        return f"{self.category}.{self.name}"


CATALOG: dict[str, CheckSpec] = {}


def check(category: str, severity: str = "medium", name: str | None = None):
    """Register a check function; its signature is the parameter contract."""

    def wrap(fn: Callable[..., Any]) -> Callable[..., Any]:
        params = list(inspect.signature(fn).parameters.values())[1:]
        spec = CheckSpec(
            name=name or fn.__name__,
            category=category,
            severity=severity,
            fn=fn,
            description=(fn.__doc__ or "").strip().split("\n")[0],
            required=tuple(p.name for p in params if p.default is inspect.Parameter.empty),
            defaults={p.name: p.default for p in params if p.default is not inspect.Parameter.empty},
        )
        CATALOG[spec.key] = spec
        return fn

    return wrap


def find(name: str) -> CheckSpec:
    """Look a check up by ``Name`` (any case) or ``category.Name``."""
    import plumbline.operators.checks  # noqa: F401  (fills the catalog on first use)
    if name in CATALOG:
        return CATALOG[name]
    for spec in CATALOG.values():
        if name.lower() in (spec.name.lower(), spec.key.lower()):
            return spec
    raise KeyError(f"unknown check {name!r}")


def by_category(category: str) -> list[CheckSpec]:
    return [s for s in CATALOG.values() if s.category == category]


def search(text: str, category: str | None = None) -> list[CheckSpec]:
    """Checks whose name or description contains ``text``, ignoring case."""
    needle = text.lower()
    return [s for s in CATALOG.values()
            if (category is None or s.category == category)
            and (needle in s.name.lower() or needle in s.description.lower())]


@dataclass(frozen=True)
class CheckConfig:
    """A request to run one check. Empty parameters mean 'not given'."""

    name: str
    params: dict[str, Any] = field(default_factory=dict, hash=False)
    enabled: bool = True
    severity: str | None = None

    def normalised(self) -> dict[str, Any]:
        kept = {k: tuple(v) if isinstance(v, list) else v
                for k, v in self.params.items() if v is not None and v != "" and v != []}
        spec = find(self.name)
        missing = [p for p in spec.required if p not in kept]
        unknown = [p for p in kept if p not in spec.required and p not in spec.defaults]
        if missing:
            raise ValueError(f"{spec.name}: missing parameter {', '.join(missing)}")
        if unknown:
            raise ValueError(f"{spec.name}: unknown parameter {', '.join(unknown)}")
        return kept
