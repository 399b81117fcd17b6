"""All queries of the library, and their SQL."""

from __future__ import annotations

from . import alignment, decisions, extras, features, indicators, paper, recurrences, requests, scalars, sources, streams, trading

_MODULES = (indicators, recurrences, alignment, trading, decisions, scalars, features, paper, streams, sources, extras, requests)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
