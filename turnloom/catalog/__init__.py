"""Queries by name. Importing the modules registers them."""

from turnloom.catalog import benchmarks, corpus, datasets, judging, similarity, statistics, streaming, texts  # noqa: F401
from turnloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
