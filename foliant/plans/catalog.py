"""The registered queries of the documentary operators, and their SQL."""

from __future__ import annotations

from foliant.plans import (  # noqa: F401  (importing registers)
    analysis_queries,
    compare_queries,
    corpus_queries,
    extraction_queries,
    graph_queries,
    grounding_queries,
    learning_queries,
    links_queries,
    lookup_queries,
    reading_queries,
    records_queries,
    retrieval_queries,
    source_queries,
    splits_queries,
    synthesis_queries,
    topic_queries,
    timeline_queries,
)
from foliant.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
