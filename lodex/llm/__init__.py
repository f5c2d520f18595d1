"""Operators of a training-data pipeline: packing, mixing, scoring, search and deduplication.

Nothing else in the library imports this subpackage.
"""
