"""Every query of the core and, where SQL can express it, the same result in DuckDB SQL."""

from __future__ import annotations

from . import documents, mechanisms, metrics, pipeline, register, retrieval, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (retrieval, register, text, metrics, documents, mechanisms, pipeline):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
