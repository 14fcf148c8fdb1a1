"""Sievework: functions."""
