"""Connected components of an edge table: those of the graph operators."""

from pointloom.operators.graph import connected_components

__all__ = ["connected_components"]
