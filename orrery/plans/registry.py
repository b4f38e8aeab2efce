"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from orrery.plans import catalog, changes, ingestion, retrieval, streams, texts, vectors

QUERIES = retrieval.QUERIES | catalog.QUERIES | changes.QUERIES | texts.QUERIES | ingestion.QUERIES | streams.QUERIES | vectors.QUERIES
SQL = retrieval.SQL | catalog.SQL | changes.SQL | texts.SQL | ingestion.SQL | streams.SQL | vectors.SQL
FLAGSHIP = "rrf_hybrid_topk"
