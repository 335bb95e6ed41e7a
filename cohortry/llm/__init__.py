"""Operators of a training-data pipeline: sharding, filtering, deduplication, scanning, mixing, tokenizing.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
