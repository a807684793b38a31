"""Readers, repairs and sinks."""
