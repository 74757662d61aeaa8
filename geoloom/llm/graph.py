"""Connected components of a table of pairs, each round a table in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from geoloom.llm.common import materialize
from geoloom.operators.graphs import star_components


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(a, b) long pairs -> (node, root): the least node of each node's component, for nodes on a pair."""
    return star_components(edges, lambda df: materialize(df, tag))
