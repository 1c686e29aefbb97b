"""Radiolake streaming."""
