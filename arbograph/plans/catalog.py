"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from arbograph.plans import graph_queries, retrieval_queries, structure_queries

QUERIES: dict = {**graph_queries.QUERIES, **structure_queries.QUERIES, **retrieval_queries.QUERIES}
ORACLES: dict[str, str] = {**graph_queries.ORACLES, **structure_queries.ORACLES, **retrieval_queries.ORACLES}
