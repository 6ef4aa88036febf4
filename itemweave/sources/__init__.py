"""Readers and writers for transaction text, long tables and layouts."""
