"""Logical algebra and its rewrites."""
