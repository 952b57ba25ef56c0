"""Operators for training-data pipelines: tokenising, deduplication, filtering, sharding and packing.

Nothing else in the library imports this subpackage.
"""
