"""Radiolake operators."""
