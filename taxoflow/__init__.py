"""Lexicon and ontology matching, and large-scale text table processing, on Spark."""

__version__ = "0.1.0"
