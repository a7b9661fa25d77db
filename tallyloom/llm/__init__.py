"""Training-data operators: tokenising, filtering, deduplicating, scoring and packing text corpora.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries; the operators live in one module each.
"""
