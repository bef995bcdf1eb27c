"""Operators over DataFrames of documents, segments and results."""
