"""Batch pipelines made of the operators."""
