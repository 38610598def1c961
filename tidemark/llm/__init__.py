"""Training-data operators: search, de-duplication, extraction, tokens, filters and scores.

Nothing else in the library imports this package; ``queries`` registers its queries.
"""
