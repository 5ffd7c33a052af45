"""Named queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["segments", "dashboards", "frames", "vectors", "words", "streams", "files"]


def load():
    """All registered queries and their SQL twins."""
    from .registry import ORACLE, QUERIES

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return QUERIES, ORACLE
