"""Tessera: a Spark-native retrieval, context-assembly and corpus-processing engine."""

__version__ = "0.1.0"
