"""Operators on bags of solution mappings, as DataFrame operations."""
