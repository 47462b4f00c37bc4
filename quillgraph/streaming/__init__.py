"""Streams of texts and accesses into the graph."""
