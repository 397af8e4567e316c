"""The catalogue of named queries."""

from __future__ import annotations

from rosterlake.operators import packed
from rosterlake.plans import q_composite, q_pipeline, q_relational, q_text

_MODULES = (packed, q_text, q_relational, q_pipeline, q_composite)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
