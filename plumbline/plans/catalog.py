"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from plumbline.plans import code_queries, edit_queries, finding_queries, function_queries, graph_queries, project_queries, quality_queries, record_queries, service_queries, similarity_queries, stream_queries, vote_queries, workflow_queries
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code_queries", "edit_queries", "finding_queries", "function_queries", "graph_queries", "project_queries", "quality_queries", "record_queries", "service_queries", "similarity_queries", "stream_queries", "vote_queries", "workflow_queries"]
