"""Registered queries, one module per family."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    from chronoweave.plans.registry import REGISTRY

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY
