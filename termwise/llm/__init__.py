"""Operators and stages for preparing language-model training data."""
