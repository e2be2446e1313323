"""Readers, source profiling and writers."""
