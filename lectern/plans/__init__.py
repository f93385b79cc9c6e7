"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

from lectern.plans import registry

AREAS = ["retrieval", "progress", "questions", "mining", "ingest", "curriculum", "catalogue", "answers", "streams"]


def load() -> tuple[dict[str, registry.Query], dict[str, str]]:
    for area in AREAS:
        importlib.import_module(f"lectern.plans.{area}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
