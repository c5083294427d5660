"""Operators over booking tables."""
