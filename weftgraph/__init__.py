"""weftgraph: graphs and relational tables as equal citizens on PySpark.

A graph is an immutable bundle of DataFrames, every operator is a DataFrame
plan, and Catalyst is the only intermediate representation.
"""

from .graph import Graph, Segmentation

__all__ = ["Graph", "Segmentation"]
