"""Operators of a training-data pipeline: quality, tokens, duplicates, mixing, privacy, language.

Nothing else in the library imports this subpackage, and it may be removed as a whole.
"""
