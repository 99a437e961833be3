"""Lodestone: an analytics engine on DataFrame, SQL and Structured Streaming operations."""
