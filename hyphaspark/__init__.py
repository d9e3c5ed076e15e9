"""Habitat and timing analytics on Spark."""
