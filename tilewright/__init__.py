"""Tile statistics, leakage-safe preparation and model selection as Spark plans."""
