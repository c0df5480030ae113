"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the query registry picks it up
only where it is present.
"""
