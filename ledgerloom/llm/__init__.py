"""Operators for training-data work on text tables."""
