"""Skewed data generators."""
