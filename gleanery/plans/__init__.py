"""Registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

MODULES = ("tables", "scalars", "entities", "documents", "retrieval", "traces", "ledgers", "regions", "evidence", "rules")


def catalogs():
    return [import_module(f"gleanery.plans.{m}").CATALOG for m in MODULES]


def all_queries():
    return {name: fn for c in catalogs() for name, fn in c.runs.items()}


def all_checks():
    return {name: sql for c in catalogs() for name, sql in c.checks.items()}
