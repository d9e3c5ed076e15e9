"""Dimension tables, landed feeds and the adapters over star-schema tables."""
