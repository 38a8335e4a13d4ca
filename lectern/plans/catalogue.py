"""All queries of the reference's operators, with their SQL."""

from __future__ import annotations

from . import container_queries, context_queries, job_queries, layout_queries, stream_queries, text_queries

_MODULES = (text_queries, context_queries, job_queries, layout_queries, container_queries, stream_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in _MODULES for k, v in m.SQL.items()}
