"""Orrery: a Spark-first analytics engine for gridded observations and corpora."""

__version__ = "0.1.0"
