"""Radiolake sources."""
