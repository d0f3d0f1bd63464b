"""Training-data operators: language id, packing, dedup, quality, search, tokens.

Nothing else in the library imports this subpackage.
"""
