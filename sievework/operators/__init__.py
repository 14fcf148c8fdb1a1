"""Sievework: operators."""
