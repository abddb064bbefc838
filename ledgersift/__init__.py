"""Screening of general-ledger journal entries on Spark."""
