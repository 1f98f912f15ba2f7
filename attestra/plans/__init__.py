"""Composed plans: the whole analysis, and the registered queries over the sample tables."""
