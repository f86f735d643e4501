"""modgraph: dependency-graph analytics over hierarchical names, on PySpark."""

__version__ = "0.1.0"
