"""Operators for preparing text and code collections for language-model training."""
