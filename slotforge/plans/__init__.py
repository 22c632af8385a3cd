"""Sizing, configuration and measurement."""
