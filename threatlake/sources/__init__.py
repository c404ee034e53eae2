"""Readers, sinks and profiles of stored data."""
