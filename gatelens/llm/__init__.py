"""Training-data operators: near-duplicates, media chunks, filters, classifiers, packing, tokens.

Nothing outside this subpackage imports it.
"""
