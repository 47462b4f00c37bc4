"""Memory-graph analytics on Spark: nodes and edges are DataFrames, every operator maps DataFrames to DataFrames."""

__version__ = "0.1.0"
