"""Dimensions and readers."""
