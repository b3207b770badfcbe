"""Operators for large training corpora; nothing else in docweft imports this package."""
