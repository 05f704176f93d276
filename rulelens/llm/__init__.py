"""Training-data operators: deduplication, archives, privacy, licences, formatting, tokens, quality.

Nothing outside this package imports it; it imports nothing of the rest of the library.
"""
