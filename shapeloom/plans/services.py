"""Services: named pipelines that may use each other.

A service is a function of a context that returns a DataFrame.  It asks the context for its parameters and
for other services; a service that comes to need itself is an error.  Nothing runs while plans are put
together, and equal scans within one are read once (``ReusedExchange``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..sources.catalog import Catalog


class ServiceError(ValueError):
    """A service that isn't known, or needs itself."""


@dataclass(frozen=True)
class Context:
    services: Services
    catalog: Catalog | None = None
    requests: DataFrame | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    within: tuple[str, ...] = ()

    def param(self, path: str) -> Any:
        """A value of the params at a dotted path; None if it isn't there."""
        value: Any = self.params
        for step in path.split("."):
            value = value.get(step) if isinstance(value, Mapping) else None
        return value

    def service(self, name: str, **params: Any) -> DataFrame:
        return self.services.run(name, self, params)


class Services:
    def __init__(self) -> None:
        self._functions: dict[str, Callable[[Context], DataFrame]] = {}

    def add(self, name: str, function: Callable[[Context], DataFrame]) -> None:
        if name in self._functions:
            raise ServiceError(f"{name} is already a service")
        self._functions[name] = function

    def run(self, name: str, context: Context | None = None, params: Mapping[str, Any] | None = None) -> DataFrame:
        context = context or Context(self)
        if name not in self._functions:
            raise ServiceError(f"no service {name}")
        if name in context.within:
            raise ServiceError(" -> ".join((*context.within, name)))
        return self._functions[name](Context(self, context.catalog, context.requests, dict(params or {}), (*context.within, name)))
