"""plexgraph: code-intelligence property graphs on PySpark."""

__version__ = "0.1.0"
