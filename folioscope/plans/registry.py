"""Every registered query of the imaging operators with its SQL."""

from __future__ import annotations

from . import chain_queries, imaging_queries, packed_queries, page_queries

QUERIES: dict = {**imaging_queries.QUERIES, **page_queries.QUERIES, **packed_queries.QUERIES, **chain_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**imaging_queries.SQL, **page_queries.SQL, **packed_queries.SQL, **chain_queries.SQL}
