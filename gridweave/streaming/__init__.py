"""Structured Streaming forms of three batch operators; each gives the batch result once the input is read."""
