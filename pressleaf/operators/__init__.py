"""Operators over tables of pages and assets."""
