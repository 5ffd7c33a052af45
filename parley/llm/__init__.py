"""Operators for training-data pipelines: text statistics, duplicates, mixing, tokens, archives.

Nothing outside this package imports it, except for the driver's entry, which does without it when it is absent.
"""

from __future__ import annotations


def load():
    """The registered queries of this package and their SQL twins."""
    from . import queries

    return queries.QUERIES, queries.ORACLE
