"""Training-data operators: dedup, decontamination, extraction, packing, search.

Nothing outside this subpackage imports it.
"""
