"""Tessera: a PySpark-native array analytics engine."""

__version__ = "0.1.0"
