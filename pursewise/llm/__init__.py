"""Operators of a training-data pipeline (near-duplicates, tokens, mixing, filters, search).

Nothing else in the package imports this folder. Queries and oracles are in ``queries``.
"""
