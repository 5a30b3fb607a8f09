"""Quayside: the data work behind a research-dataset portal, as PySpark DataFrame operators."""

__version__ = "0.1.0"
