"""Registered queries over the driver tables."""

import importlib

_MODULES = [
    "rule_queries", "scan_queries", "adapter_queries", "text_queries",
    "merge_queries", "extract_queries", "stream_queries",
]


def all_queries():
    """(queries, oracles) of every query module."""
    from labelscan.plans import registry

    for name in _MODULES:
        importlib.import_module(f"labelscan.plans.{name}")
    return registry.QUERIES, registry.ORACLES
