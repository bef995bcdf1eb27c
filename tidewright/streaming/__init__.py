"""Incremental runs: documents or results that arrive over time."""
