"""All registered queries."""

from __future__ import annotations

import importlib

from . import registry

MODULES = ["indicator_queries", "metric_queries", "rule_queries", "data_queries", "portfolio_queries", "model_queries", "account_queries", "stream_queries"]

for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")


def queries():
    return dict(registry.QUERIES)


def checks():
    return dict(registry.CHECKS)
