"""Quantitative analytics as Spark plans."""
