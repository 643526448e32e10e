"""Training-data operators: tokenising, quality, archives, near duplicates, mixing, scoring.

Nothing else in the package imports this subpackage; its queries are in ``queries``.
"""
