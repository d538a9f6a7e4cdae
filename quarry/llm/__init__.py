"""Training-data operators: tokenizers, search, classifiers, deduplication, archives.

Nothing outside this subpackage imports it.
"""
