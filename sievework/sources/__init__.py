"""Sievework: sources."""
