"""Operators for preparing language-model training data, apart from the rest of the library."""
