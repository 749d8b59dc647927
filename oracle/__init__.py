"""ANSI SQL twins of the registered queries, for an independent engine."""

from __future__ import annotations

from importlib import import_module

MODULES = ("market", "news", "ingest", "backtest", "sequences", "profile", "model", "attention", "storage")


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"oracle.{name}").SQL
    return found
