"""Applying a stored plan to micro-batches."""
