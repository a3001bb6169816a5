"""Scans, sinks, ledgers and publishing."""
