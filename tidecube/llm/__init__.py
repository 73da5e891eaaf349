"""Operators that prepare training data for language models. Nothing else in tidecube imports this package."""
