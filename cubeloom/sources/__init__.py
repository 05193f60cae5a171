"""Readers and writers of cube tables and benchmark files."""
