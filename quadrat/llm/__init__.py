"""Training-data operators: fingerprints, dedup, scoring, archives, search, encoding, sharding, mixing.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries and SQL.
"""
