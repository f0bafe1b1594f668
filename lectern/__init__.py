"""Lectern: document preparation, retrieval and evaluation as PySpark DataFrame transforms."""

__version__ = "0.1.0"
