"""Operators on texts and very large numeric columns for training data."""
