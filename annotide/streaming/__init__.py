"""Readings as streams."""
