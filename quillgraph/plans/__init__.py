"""Execution helpers: durable intermediate tables and checked broadcasts."""
