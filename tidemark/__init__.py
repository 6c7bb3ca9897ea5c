"""Tidemark: a PySpark-native engine for change analytics over semi-structured documents."""

__version__ = "0.1.0"
