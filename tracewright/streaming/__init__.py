"""Structured Streaming: ingest, attachment, pairing, balances, windows."""
