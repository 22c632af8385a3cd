"""Operators on key sets: build, look up, verify, encode, apply."""
