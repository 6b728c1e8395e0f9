"""Readers, views and sinks."""
