"""notegrid: a PySpark-native engine for knowledge-graph vaults."""

__version__ = "0.1.0"
