"""Registered queries over the driver's tables, by topic, with the SQL that gives the same rows."""

from __future__ import annotations

MODULES = ("catalog", "links", "fits", "texts", "publish", "reports", "collect")


def _gather(kind: str) -> dict:
    from importlib import import_module

    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"quarry.plans.{name}"), kind)()
        twice = sorted(out.keys() & part.keys())
        if twice:
            raise ValueError(f"queries registered twice: {twice}")
        out |= part
    return out


def queries() -> dict:
    return _gather("queries")


def oracle_sql() -> dict:
    return _gather("oracle_sql")
