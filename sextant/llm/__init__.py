"""Training-data operators: deduplication, sharding, mixing, scoring, tokenising.

Each module holds one operator with its own interface; ``queries`` binds them
to whole tables. Nothing outside this subpackage imports it.
"""
