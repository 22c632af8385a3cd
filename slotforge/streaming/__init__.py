"""Lookups in streams."""
