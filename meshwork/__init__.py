"""A graph and network analytics engine whose operators are Spark DataFrame plans."""

__version__ = "0.1.0"
