"""Operators for preparing text corpora: splitting, pair statistics, near duplicates, tokens, packing, abuse scores.

Nothing outside this package imports it.
"""
