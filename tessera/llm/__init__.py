"""Training-data operators: sharding, filters, deduplication, tokenisation, chat formatting.

Nothing else in the library imports this subpackage.
"""
