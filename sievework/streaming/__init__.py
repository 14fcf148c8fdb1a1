"""Sievework: streaming."""
