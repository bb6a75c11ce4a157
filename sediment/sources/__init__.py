"""Readers and writers of tables and binary formats."""
