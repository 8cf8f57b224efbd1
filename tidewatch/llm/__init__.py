"""Operators for preparing training text: duplicates, packing, toxicity, personal data, archives, search, tokens.

Nothing else in the package imports this subpackage. Every operator takes and returns DataFrames and names its
columns by parameters, so extra columns of the input, also ones with clashing names, are never touched.
"""
