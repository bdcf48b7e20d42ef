"""Registered queries, one module per part of the inventory."""

import importlib

MODULES = [
    "corpus_lint",
    "corpus_structure",
    "corpus_versions",
    "folders",
    "projections",
    "joins",
    "aggregates",
    "windows",
    "setops",
    "generators",
    "scalars",
    "tables_io",
    "advice",
    "reports",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"scriptmill.plans.{name}")
