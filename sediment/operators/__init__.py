"""Operators over operation logs and sorted runs."""
