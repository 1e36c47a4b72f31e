"""kinweave: a Spark-native entity-resolution and corpus engine."""

__version__ = "0.1.0"
