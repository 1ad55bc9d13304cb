"""Connected components with their rounds in the folder of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import components
from .store import stored


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component."""
    return components.connected(edges, lambda df: stored(df, name))
