"""Operators for training-data corpora: deduplication, tokenizing, packing, quality, toxicity.

Each module holds one operator with a general interface; ``queries`` registers the thin
``opN_<name>`` queries over the driver tables.  Nothing outside this subpackage imports it.
"""
