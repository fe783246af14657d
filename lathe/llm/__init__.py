"""Training-data operators: mixing, extraction, decontamination, quality, tokens, dedup.

Nothing else in the package imports this subpackage.
"""
