"""Readers, landing and sinks."""
