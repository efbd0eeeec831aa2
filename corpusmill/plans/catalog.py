"""All queries of the retrieval engine, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from corpusmill.plans import corpus_queries, index_queries, search_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for group in (corpus_queries, text_queries, search_queries, index_queries, stream_queries):
    QUERIES |= group.QUERIES
    ORACLES |= group.ORACLES
FLAGSHIP = QUERIES["r9_hybrid_retrieve"]
