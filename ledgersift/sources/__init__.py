"""Readers, column binding and ingest of ledger extracts."""
