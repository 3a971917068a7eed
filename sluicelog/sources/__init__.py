"""Scans of raw logs into the three fixed tables."""
