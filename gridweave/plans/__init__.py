"""Registered queries: each is a Spark plan over the tables of a folder, with its SQL counterpart if it has one."""

from __future__ import annotations

import importlib

from gridweave.plans.catalog import Catalog

MODULES = ["metrics", "scalars", "grids", "filling", "labels", "texts", "coverage", "sets"]


def load() -> Catalog:
    catalog = Catalog()
    for name in MODULES:
        importlib.import_module(f"gridweave.plans.{name}").register(catalog)
    return catalog
