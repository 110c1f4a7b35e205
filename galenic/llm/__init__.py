"""Training-data operators: deduplication, classifiers, fingerprints, sharding, mixing and tokenization.

Nothing outside this subpackage imports it.
"""
