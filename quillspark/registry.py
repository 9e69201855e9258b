"""All core queries with their SQL counterparts, gathered from the plan modules."""

from __future__ import annotations

from .plans import ingest as _ingest
from .plans import report as _report
from .plans import review as _review
from .plans import search as _search
from .plans import streams as _streams
from .plans import text as _text
from .plans import units as _units

MODULES = [_text, _ingest, _search, _review, _report, _streams, _units]


def queries() -> dict:
    out: dict = {}
    for module in MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out |= module.ORACLE
    return out
