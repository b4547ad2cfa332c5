"""Loomline: a PySpark-native engine for curating, verifying and evaluating code-reasoning data."""
