"""Guardrail analytics on Spark: bulk scoring, decision replay, metrics, run comparison, streams."""

__version__ = "0.1.0"
