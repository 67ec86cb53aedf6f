"""Readers, writers and the mapping from the given tables to a stock ledger."""
