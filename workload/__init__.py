"""Queries over the test tables, their oracles and the check that compares them."""

from __future__ import annotations

import importlib

MODULES = ["q_validation", "q_links", "q_classify", "q_extract", "q_containers", "q_streams"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
