"""tidemark: a Spark-native engine for text facts that change over time."""

__version__ = "0.1.0"
