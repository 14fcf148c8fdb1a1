"""Sievework: plans."""
