"""Whole pipelines put together from operators."""
