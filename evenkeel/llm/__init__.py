"""Training-data operators: deduplication, tokenisation, filtering and scanning of document corpora.

Nothing else in the library imports this package, so it can be removed whole.
"""
