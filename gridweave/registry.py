"""Operators by name, for `df.transform(OPERATORS[name], ...)` and for listing what there is."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from gridweave.operators import coverage, fill, grid, labels, metrics, roles, sets, texts
from gridweave.sources import cells, files, sinks

MODULES = [metrics, grid, roles, fill, labels, texts, coverage, sets, files, cells, sinks]


def operators() -> dict[str, Callable]:
    """Public functions whose first argument is a DataFrame, by `module.name`."""
    found: dict[str, Callable] = {}
    for module in MODULES:
        for name, item in vars(module).items():
            if name.startswith("_") or not inspect.isfunction(item) or item.__module__ != module.__name__:
                continue
            first = next(iter(inspect.signature(item).parameters.values()), None)
            if first is not None and first.annotation == "DataFrame":
                found[f"{module.__name__.rsplit('.', 1)[-1]}.{name}"] = item
    return found


def describe() -> list[tuple[str, str]]:
    return [(name, (function.__doc__ or "").strip().split("\n")[0]) for name, function in operators().items()]


OPERATORS = operators()
