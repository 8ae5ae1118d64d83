"""Operators for preparing training text: dedup, scoring, filtering, mixing, packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames.
"""
