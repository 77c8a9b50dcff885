"""Bulk detectors: expressions where possible, the batch scorer for models."""
