"""Operators for preparing training text: mixing, personal data, quality, duplicates, packing, sharding, toxicity.

Every module holds one operator, its query ``opN_<name>`` and, where SQL can state it, the query's oracle.
"""
