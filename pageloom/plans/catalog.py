"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _module in ("store_queries", "page_queries", "control_queries", "search_queries", "stream_queries"):
    importlib.import_module(f"{__package__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
