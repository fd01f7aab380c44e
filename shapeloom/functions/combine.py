"""Functions of functions: everything is put together before Spark sees a plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Stands for the argument of a partial application that is still to come.
HOLE = object()


def chain(value: Any, *functions: Callable[..., Any]) -> Any:
    """The value through one function after the other."""
    for f in functions:
        value = f(value)
    return value


def compose(*functions: Callable[..., Any]) -> Callable[..., Any]:
    """A function that passes its arguments to the first, and on."""
    first, *rest = functions
    return lambda *args: chain(first(*args), *rest)


def partial(f: Callable[..., Any], *args: Any, **named: Any) -> Callable[..., Any]:
    """f with some arguments; later ones fill the holes from left to right."""

    def filled(*more: Any) -> Any:
        rest = iter(more)
        return f(*(next(rest) if a is HOLE else a for a in args), *rest, **named)

    return filled
