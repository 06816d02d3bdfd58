"""Operators that prepare text for language-model training.

Nothing outside this package imports it; it may use the rest of the library.
"""
