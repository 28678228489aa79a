"""Registered queries over the provided tables."""
