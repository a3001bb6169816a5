"""Structured Streaming forms of the ledger, spend and rate-limit operators."""
