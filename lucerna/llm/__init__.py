"""Training-data operators: scoring, deduplication, formatting, packing and mixing of text corpora.

Nothing else in the library imports this subpackage.
"""
