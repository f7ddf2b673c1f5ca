"""Targeting, placement, salting, rewrite decisions and join plans."""
