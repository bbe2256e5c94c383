"""Structured Streaming forms of the journal and inventory operators."""
