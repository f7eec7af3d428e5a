"""Training-data operators: scans, near-duplicate joins, fingerprints, mixing, packing, search and scoring.

Nothing outside this subpackage imports it.
"""
