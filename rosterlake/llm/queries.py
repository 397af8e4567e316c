"""Queries of the llm operators and the SQL they are checked against."""

from __future__ import annotations

import importlib

_MODULES = ("p1_address", "p2_survivor", "p3_names", "p4_neardup", "p6_linkage", "p7_formatting", "p8_tokens", "p9_packing", "p10_pii")


def _collect(kind: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        try:
            module = importlib.import_module(f"rosterlake.llm.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"rosterlake.llm.{name}":  # the module is there but lacks a dependency
                raise
            continue
        out |= getattr(module, kind, {})
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
