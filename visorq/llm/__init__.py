"""Training-data operators: dedup, archives, tokenization, secrets, PII, quality, decontamination.

Nothing else in the library imports this subpackage.
"""
