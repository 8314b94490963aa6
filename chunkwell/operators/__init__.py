"""Operators over DataFrames of texts."""
