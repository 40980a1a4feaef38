"""Readers, feed parsing, table layout and exports."""
