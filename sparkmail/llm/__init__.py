"""Operators of a training-data pipeline: filters, scans, dedup, packing.

Each module holds one operator with its own interface; ``queries`` registers
the ``opN_*`` queries over the driver's tables, ``oracles`` their SQL.
"""
