"""Structural-variant analytics on Spark."""
