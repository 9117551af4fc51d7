"""Subgraph queries on labelled graphs held in DataFrames."""

from weftgraph.engine import catalog_info, count, explain, match, run_plan
from weftgraph.graph import PropertyGraph
from weftgraph.pattern import Pattern

__all__ = ["Pattern", "PropertyGraph", "catalog_info", "count", "explain", "match", "run_plan"]
