"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("profiling", "statistics", "catalogue", "models")


def registered() -> dict:
    from tablescope.checks.registry import REGISTRY

    for name in MODULES:
        importlib.import_module(f"tablescope.checks.{name}")
    return dict(REGISTRY)
