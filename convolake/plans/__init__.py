"""Whole pipelines: feature store, cross-validation and prediction."""
