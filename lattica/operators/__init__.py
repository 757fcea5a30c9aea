"""Relational, text and layout operators over DataFrames."""
