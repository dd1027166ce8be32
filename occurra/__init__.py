"""Occurrence-graph analytics on Spark: search, statistics, export and curation."""

from occurra.model import Criteria, Graph

__all__ = ["Criteria", "Graph"]
