"""Training-data operators: language-model scoring, tokenising, search, near copies, packing, filters.

Nothing else in the library imports this subpackage; it imports nothing of the rest.
"""
