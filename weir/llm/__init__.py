"""Training-data operators: quality rules, near duplicates, extraction, filters and encoders.

Nothing outside this subpackage imports it.
"""
