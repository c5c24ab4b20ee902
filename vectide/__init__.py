"""vectide: vector search and vector analytics as Spark DataFrame programs."""

__version__ = "0.1.0"
