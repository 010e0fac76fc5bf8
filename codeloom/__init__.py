"""codeloom: a Spark-native engine for property graphs over source code."""

__version__ = "0.1.0"
