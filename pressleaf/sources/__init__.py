"""Readers and writers: HTML trees, cookie files, output files."""
