"""Operators for preparing training data: filters, near copies, scoring, tokens and packing."""
