"""Streaming twins of the ledger's stateful operators."""
