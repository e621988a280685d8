"""Registered queries of the page engine."""
