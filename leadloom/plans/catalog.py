"""The registry of queries: each group of queries is one module of this package."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["identity", "texts", "joining", "changes", "ranking", "reviewing", "feed", "events", "running", "acting", "landing", "exchanging", "judging"]


def _modules():
    return [import_module(f"leadloom.plans.{name}") for name in GROUPS]


def queries() -> dict:
    return {name: q for m in _modules() for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark, sf_dir: str):
    return queries()["m3_feed_page"](spark, sf_dir)
