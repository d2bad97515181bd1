"""Readers and their page, cell and layout tables."""
