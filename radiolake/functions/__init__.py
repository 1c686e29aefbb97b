"""Radiolake functions."""
