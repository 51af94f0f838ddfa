"""Operators of a training-data pipeline: packing, sharding, filters, dedup, search.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin ``opN_<name>`` queries.
"""
