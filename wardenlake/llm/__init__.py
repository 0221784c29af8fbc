"""Operators for preparing training data: identification, scoring, tokens, near copies, archives, packing."""
