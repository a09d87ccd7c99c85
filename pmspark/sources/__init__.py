"""Readers, sinks and the manifest."""
