"""lamina: layered (read -> molecule -> archive) open-set classification analytics on Spark DataFrames."""

__version__ = "0.1.0"
