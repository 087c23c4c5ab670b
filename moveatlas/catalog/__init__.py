"""Runnable queries over the test tables and their reference SQL."""

from __future__ import annotations


def _load():
    from moveatlas.catalog import counts_queries, io_queries, moves_queries, registry

    return registry


def all_queries():
    """Every registered query by name."""
    return dict(_load().QUERIES)


def all_oracles():
    """Reference SQL by query name."""
    return dict(_load().ORACLES)
