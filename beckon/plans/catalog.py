"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

from beckon.plans import registry

MODULES = ["flagship_q", "sources_q", "mapping_q", "quality_q", "redact_q", "filters_q", "joins_q", "metrics_q", "ranking_q", "scoring_q", "delivery_q", "streaming_q"]

for _m in MODULES:
    importlib.import_module(f"beckon.plans.{_m}")


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
