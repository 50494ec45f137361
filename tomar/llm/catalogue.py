"""The queries of this subpackage, and SQL where it can express the result."""

from __future__ import annotations

from . import crosssplit, entities, evalleak, langid, lookalike, mixture, ocrnoise, pieces, pii

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (crosssplit, pii, entities, ocrnoise, pieces, lookalike, evalleak, mixture, langid):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
