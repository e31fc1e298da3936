"""Tiered-memory analytics on Spark: windowing, novelty gating, episodes, events, retrieval, evaluation."""

__version__ = "0.1.0"
