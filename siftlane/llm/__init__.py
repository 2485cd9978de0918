"""Operators for training data: near-duplicates, similar vectors, runs, packing, mixing, text forms.

Nothing outside this subpackage imports it.
"""
