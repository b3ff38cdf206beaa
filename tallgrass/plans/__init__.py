"""All queries; importing a module registers its own."""

from . import account_queries, canonical_queries, catalog_queries, control_queries, decision_queries, document_queries, edit_queries, ingest_queries, lifecycle_queries, matching_queries, profile_queries, record_queries, state_queries, stream_queries, text_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "account_queries", "canonical_queries", "catalog_queries", "control_queries", "decision_queries", "document_queries", "edit_queries", "ingest_queries", "lifecycle_queries", "matching_queries", "profile_queries", "record_queries", "state_queries", "stream_queries", "text_queries"]
