"""Question answering and text retrieval over document collections, as Spark plans."""

__version__ = "1.0.0"
